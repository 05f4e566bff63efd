"""Tax-return totals, the cross-check with bank credits and the input-tax reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.numbers import half_up, percent_of
from creditloom.functions.rules import is_credit, level_of, texts_where
from creditloom.session import shared_folder

TAXABLE = ("taxable", "value")
TXN_TYPE = ("type", "txn")
AMOUNT = ("amount", "amt")


def resolve_column(df: DataFrame, tokens: Sequence[str], default: str | None = None) -> str | None:
    """The first column whose name contains one of the tokens."""
    return next((c for c in df.columns if any(t in c.lower() for t in tokens)), default)


EXACT = "decimal(28,6)"


def _amount(column: str) -> Column:
    """A cell as an exact number; null for text that is none, so that one bad cell does not end the job."""
    return F.col(column).try_cast(EXACT)


def _total(amount: Column) -> Column:
    """Summed exactly and rounded once."""
    return F.round(F.sum(amount), 2).try_cast("decimal(28,2)")


def _n_unusable(column: str) -> Column:
    return F.count_if(F.col(column).isNotNull() & _amount(column).isNull())


def gst_revenue(gst: DataFrame, key: str = "company_id") -> DataFrame:
    others = [c for c in gst.columns if c != key]
    column = resolve_column(gst, TAXABLE, others[2] if len(others) > 2 else None)
    return gst.groupBy(key).agg(_total(_amount(column)).alias("gst_revenue"), _n_unusable(column).alias("n_unusable_values"))


def bank_credits(bank: DataFrame, key: str = "company_id") -> DataFrame:
    kind, amount = resolve_column(bank, TXN_TYPE), resolve_column(bank, AMOUNT)
    if kind and amount:
        value, unusable = F.when(is_credit(F.col(kind)), _amount(amount)), _n_unusable(amount)
    else:
        value, unusable = F.lit(0).cast(EXACT), F.lit(0).cast("bigint")
    total = F.coalesce(_total(value), F.lit(0).cast("decimal(28,2)"))
    return bank.groupBy(key).agg(total.alias("bank_credits"), unusable.alias("n_unusable_values"))


def gst_bank_align(gst: DataFrame, bank: DataFrame, key: str = "company_id") -> DataFrame:
    """One row per company with both totals; a company known to one side only gets zero on the other."""
    zero = F.lit(0).cast("decimal(28,2)")
    return (
        gst_revenue(gst, key)
        .join(bank_credits(bank, key), key, "full_outer")
        .select(
            key,
            F.coalesce("gst_revenue", zero).alias("gst_revenue"),
            F.coalesce("bank_credits", zero).alias("bank_credits"),
            F.col("bank_credits").isNull().alias("no_bank_data"),
        )
    )


def _one_decimal(pct: Column) -> Column:
    return F.round(pct, 1).cast("decimal(28,1)").cast("string")


def cross_verify(gst: DataFrame, bank: DataFrame, key: str = "company_id") -> DataFrame:
    """Declared turnover against bank credits: discrepancy, flags and risk level."""
    both = gst_bank_align(gst, bank, key)
    gap = F.abs(F.col("gst_revenue") - F.col("bank_credits"))
    both = both.withColumn("_pct", F.coalesce(percent_of(gap, F.col("bank_credits")), F.lit(0)))
    pct = F.col("_pct")
    before, after = fv.FLAG_REVENUE_MISMATCH
    return both.select(
        key,
        "gst_revenue",
        "bank_credits",
        half_up(pct, 2).alias("discrepancy_pct"),
        texts_where(
            (pct > 20, F.concat(F.lit(before), _one_decimal(pct), F.lit(after))),
            (pct > 40, fv.FLAG_CIRCULAR),
        ).alias("flags"),
        level_of(pct).alias("risk_level"),
        "no_bank_data",
    )


def itc_reconcile(gst: DataFrame, key: str = "company_id") -> DataFrame:
    """Claimed (3B) against available (2A) input tax. The flagged variance is absolute; a signed one is beside it."""
    zero = F.lit(0).cast("decimal(28,4)")
    if "return_type" not in gst.columns:
        return gst.select(key).distinct().select(
            key, *[F.lit(0.0).alias(c) for c in ("itc_claimed", "itc_available", "itc_variance", "itc_variance_pct", "signed_variance")],
            F.array(F.lit(fv.FLAG_NO_RETURN_TYPE)).alias("flags"), F.lit("low").alias("risk_level"),
        )
    tax = _amount("total_tax") if "total_tax" in gst.columns else F.lit(0).cast(EXACT)

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("return_type") == kind, tax)).try_cast("decimal(28,4)"), zero)

    sums = gst.groupBy(key).agg(total("GSTR3B").alias("_claimed"), total("GSTR2A").alias("_available"))
    matched = F.col("_available") > 0
    gap = (F.col("_claimed") - F.col("_available")).cast("decimal(24,4)")
    pct = F.when(matched, F.abs(gap) / F.col("_available").cast("decimal(24,4)") * F.lit(100))
    sums = sums.withColumns({"_gap": gap, "_pct": pct})
    before, after = fv.FLAG_ITC_MISMATCH
    pct = F.col("_pct")

    def shown(c: Column) -> Column:
        return F.when(matched, half_up(c, 2)).otherwise(0.0)

    return sums.select(
        key,
        shown(F.col("_claimed")).alias("itc_claimed"),
        shown(F.col("_available")).alias("itc_available"),
        shown(F.abs("_gap")).alias("itc_variance"),
        shown(pct).alias("itc_variance_pct"),
        shown(F.col("_gap")).alias("signed_variance"),
        texts_where(
            (pct > 20, F.concat(F.lit(before), _one_decimal(pct), F.lit(after))),
            (pct > 40, fv.FLAG_ITC_SEVERE),
            (~matched, fv.FLAG_NO_2A),
        ).alias("flags"),
        level_of(pct).alias("risk_level"),
    )


QUARTERS = (1, 2, 3)
UNITS = 10_000  # of a described value; four decimals are kept


def _bucket_counts(values: DataFrame, spans: dict[int, list[tuple[int, int]]], buckets: int) -> dict[tuple[int, int], list[Row]]:
    """The filled buckets ``bucket, n, low, high`` of every span of every column, in order; all from one pass."""
    def units(n: int) -> Column:
        return F.lit(str(n)).cast("decimal(33,0)")

    placed = []
    for i, own in spans.items():
        v, place = F.col(f"u{i}"), F.lit(None)
        for no, (low, high) in enumerate(own):
            width = -(-(high - low + 1) // buckets)
            bucket = F.call_function("div", v - units(low), units(width)).cast("int")
            place = F.when(v.between(units(low), units(high)), F.struct(F.lit(i).alias("i"), F.lit(no).alias("no"), bucket.alias("bucket"), v.alias("v"))).otherwise(place)
        placed.append(place)
    rows = values.select(F.explode(F.array_compact(F.array(*placed))).alias("x")).select("x.*")
    counts = rows.groupBy("i", "no", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out: dict[tuple[int, int], list[Row]] = {}
    for row in sorted(counts.collect(), key=lambda r: (r.i, r.no, r.bucket)):
        out.setdefault((row.i, row.no), []).append(row)
    return out


def values_at_ranks(values: DataFrame, extremes: dict[int, tuple[int, int]], ranks: dict[int, set[int]], buckets: int) -> dict[tuple[int, int], int]:
    """The values at zero-based ranks of columns ``u0, u1, ...`` of whole numbers, by exact selection.

    The span between a column's extremes is cut into equal buckets, which are counted; the bucket with a wanted rank,
    narrowed to the least and largest value found in it, is the next span. Every round is one pass and divides spans by
    ``buckets`` at least, so their number depends on the range of the values alone. What reaches the driver are the
    counts of ``buckets`` for each wanted rank at most.
    """
    spans = {(i, rank): (*extremes[i], rank) for i, own in ranks.items() for rank in own}
    while wide := {(i, low, high) for (i, _), (low, high, _) in spans.items() if low < high}:
        by_column = {i: sorted((low, high) for j, low, high in wide if j == i) for i in sorted({w[0] for w in wide})}
        counted = _bucket_counts(values, by_column, buckets)
        for (i, rank), (low, high, left) in spans.items():
            if low == high:
                continue
            for row in counted[i, by_column[i].index((low, high))]:
                if left < row.n:
                    spans[i, rank] = (int(row.low), int(row.high), left)
                    break
                left -= row.n
    return {key: low for key, (low, _, _) in spans.items()}


def describe_numeric(df: DataFrame, columns: Sequence[str], buckets: int = 1024) -> DataFrame:
    """count, mean, sample deviation, min, exact interpolated quartiles and max, one row per column with a value.

    Values are read with four decimals and written once to shared storage, whole numbers of units in a column each. Moments and
    extremes take one pre-aggregated pass; quartiles follow from ``values_at_ranks``. No column is sorted, and no sketch
    of it is merged in one task.
    """
    if buckets < 2:
        raise ValueError("at least two buckets")
    spark = df.sparkSession
    path = shared_folder(spark, "described")
    exact = [F.col(f"`{c}`").cast("decimal(28,4)") for c in columns]
    df.select(*[(c * F.lit(UNITS)).cast("decimal(33,0)").alias(f"u{i}") for i, c in enumerate(exact)]).write.parquet(path)
    values = spark.read.schema(", ".join(f"u{i} decimal(33,0)" for i in range(len(columns)))).parquet(path)

    def of(i: int) -> list[Column]:
        u = F.col(f"u{i}")
        plain = u.cast("double") / F.lit(float(UNITS))
        return [F.count(u).alias(f"n{i}"), F.avg(plain).alias(f"mean{i}"), F.stddev_samp(plain).alias(f"std{i}"), F.min(u).alias(f"min{i}"), F.max(u).alias(f"max{i}")]

    basic = values.agg(*[c for i in range(len(columns)) for c in of(i)]).collect()[0]
    filled = [i for i in range(len(columns)) if basic[f"n{i}"]]
    places = {i: [divmod((basic[f"n{i}"] - 1) * q, 4) for q in QUARTERS] for i in filled}
    ranks = {i: {r for at, part in own for r in (at, at + (part > 0))} for i, own in places.items()}
    found = values_at_ranks(values, {i: (int(basic[f"min{i}"]), int(basic[f"max{i}"])) for i in filled}, ranks, buckets)

    def quartile(i: int, at: int, part: int) -> float:
        low, high = found[i, at], found[i, at + (part > 0)]
        return (4 * low + part * (high - low)) / (4 * UNITS)

    rows = [(columns[i], basic[f"n{i}"], basic[f"mean{i}"], basic[f"std{i}"], int(basic[f"min{i}"]) / UNITS,
             *[quartile(i, at, part) for at, part in places[i]], int(basic[f"max{i}"]) / UNITS) for i in filled]
    return spark.createDataFrame(rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
