"""Loan training data: synthetic loans, labels, class weights, the hold-out split and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv

TWO_32 = 4_294_967_296


def prepare_loans(loans: DataFrame, key: str = "loan_id", label: str | None = None) -> DataFrame:
    """The twelve features, key and label, without rows that miss any of them."""
    extra = [label] if label else []
    return loans.select(key, *[F.col(c).cast("double") for c in fv.MODEL_FEATURES], *extra).na.drop()


def _draw(key: str, name: str, seed: int) -> Column:
    """A uniform draw from [0, 1) fixed by row, feature and seed, whatever the partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def synth_loans(ids: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    """One synthetic loan per id over fixed ranges, labelled by the default rule."""
    def whole(name: str, low: int, high: int) -> Column:
        return (F.floor(_draw(key, name, seed) * (high - low)) + low).cast("double")

    def real(name: str, low: float, high: float) -> Column:
        return _draw(key, name, seed) * (high - low) + low

    def choice(name: str, values: list[int]) -> Column:
        options = F.array(*[F.lit(v) for v in values])
        return F.element_at(options, (F.floor(_draw(key, name, seed) * len(values)) + 1).cast("int")).cast("double")

    loans = ids.select(
        F.col(key).alias("loan_id"),
        whole("loan_amount", 50_000, 5_000_000).alias("loan_amount"),
        real("interest_rate", 7.0, 24.0).alias("interest_rate"),
        real("debt_to_income", 0.0, 45.0).alias("debt_to_income"),
        whole("revolving_balance", 0, 150_000).alias("revolving_balance"),
        real("revolving_utilities", 0.0, 100.0).alias("revolving_utilities"),
        whole("total_current_balance", 0, 500_000).alias("total_current_balance"),
        whole("total_revolving_credit_limit", 5_000, 300_000).alias("total_revolving_credit_limit"),
        choice("delinquency_two_years", [0, 0, 0, 1, 2, 3]).alias("delinquency_two_years"),
        choice("inquiries_six_months", [0, 0, 1, 1, 2, 3]).alias("inquiries_six_months"),
        whole("open_accounts", 1, 25).alias("open_accounts"),
        choice("public_record", [0, 0, 0, 0, 1]).alias("public_record"),
        whole("total_accounts", 2, 40).alias("total_accounts"),
    )
    return default_label(loans)


def default_label(loans: DataFrame) -> DataFrame:
    """Points for risky values; three or more mean default."""
    points = [("debt_to_income", 30, 2), ("delinquency_two_years", 1, 3), ("interest_rate", 18, 1),
              ("public_record", 0, 2), ("inquiries_six_months", 3, 1), ("revolving_utilities", 80, 1)]
    total = sum((F.when(F.col(c) > limit, n).otherwise(0) for c, limit, n in points), F.lit(0))
    return loans.withColumn("points", total.cast("int")).withColumn("label", (F.col("points") >= 3).cast("int"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = rows / (classes * rows of the class)."""
    counts = df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(1))  # over the two class counts only
    weight = F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))
    weights = counts.select(label, weight.alias("weight"))
    return df.join(F.broadcast(weights), label)  # two rows


def stratified_split(df: DataFrame, label: str = "label", test_share: float = 0.2, seed: int = 42, key: str = "loan_id") -> DataFrame:
    """Adds ``is_test``: exactly the given share of each class, chosen by hash order.

    The class is not sorted. Hash prefixes are counted, the prefix holding the last test row is found, and
    only rows with that prefix (1 in 65,536) are ranked; the split itself is then a comparison per row.
    """
    hashed = df.where(F.col(label).isin(0, 1)).withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")))
    hashed = hashed.withColumn("_prefix", F.substring("_h", 1, 4))
    counts = hashed.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows per class
    ordered = Window.partitionBy(label).orderBy("_prefix")
    whole_class = Window.partitionBy(label)
    placed = counts.select(
        label, "_prefix",
        F.sum("_n").over(ordered).alias("_upto"), F.col("_n"),
        F.round(F.sum("_n").over(whole_class) * F.lit(str(test_share)).cast("decimal(6,4)"), 0).cast("bigint").alias("_want"),
    )
    cut = placed.where((F.col("_upto") - F.col("_n") < F.col("_want")) & (F.col("_want") <= F.col("_upto"))).select(
        label, "_prefix", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_rank"))
    near = hashed.select(label, "_prefix", "_h").join(F.broadcast(cut), [label, "_prefix"])  # one row per class
    last = near.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h"))).where("_r = _rank")
    limits = F.broadcast(last.select(label, F.col("_h").alias("_limit")))
    return hashed.join(limits, label, "left").withColumn(
        "is_test", F.coalesce(F.col("_h") <= F.col("_limit"), F.lit(False))).drop("_h", "_prefix", "_limit")


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and the macro and weighted means.

    Everything after the first aggregation works on the confusion counts.
    """
    pairs = pred.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(
        F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )))
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0).cast("bigint")), F.lit(0.0))

    per = per.withColumns({"precision": share(F.col("hits"), F.col("predicted")), "recall": share(F.col("hits"), F.col("support"))})
    per = per.withColumn("f1", F.coalesce(
        2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    scores = ["precision", "recall", "f1"]
    n = F.sum("support")
    summary = per.agg(
        n.alias("n"), F.sum("hits").alias("hits"), *[F.avg(c).alias(f"m_{c}") for c in scores],
        *[(F.sum(F.col(c) * F.col("support")) / n).alias(f"w_{c}") for c in scores],
    ).select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                 (F.col("hits") / F.col("n")).alias("f1"), F.col("n").alias("support")),
        *[F.struct(F.lit(name).alias("class"), *[F.col(f"{k}_{c}").alias(c) for c in scores], F.col("n").alias("support"))
          for name, k in (("macro avg", "m"), ("weighted avg", "w"))],
    )))
    classes = per.select(F.col("class").cast("string").alias("class"), *scores, "support")
    return classes.unionByName(summary).select("class", *[F.round(c, 4).alias(c) for c in scores], "support")
