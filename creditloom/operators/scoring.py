"""Financial rows, the five factors, the blended score, the decision and its warnings.

All of these are projections on one row per company; scores are decimals until they are shown.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.replies import rating_score
from creditloom.functions.rules import rating_band, texts_where

FACTORS = list(fv.FIVE_CS_WEIGHTS)


def dec(x: float | int | str, kind: str = "decimal(10,2)") -> Column:
    return F.lit(str(x)).cast(kind)


def missing_required(applications: DataFrame) -> DataFrame:
    """Names of the required form fields that are empty."""
    empty = [F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in ("company_name", "cin", "pan")]
    missing = F.array_compact(F.array(*empty))
    return applications.select("company_id", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def collateral_coverage(applications_value: Column, loan: Column) -> Column:
    return F.coalesce(applications_value, F.lit(0)).cast("decimal(18,2)") / F.greatest(F.coalesce(loan, F.lit(1)), F.lit(1)).cast("decimal(18,2)")


RATIO_DEFAULTS = {"debt_service_coverage": "1.5", "current_ratio": "1.2", "debt_to_equity": "1.5", "revenue_growth": "0.1"}


def base_financials(applications: DataFrame, stated: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """The working financial row of every applicant with its defaults.

    ``stated`` names the ratio columns that ``applications`` itself brings along, ``keep`` further columns to pass on.
    """
    coverage = F.round(collateral_coverage(F.col("collateral_value"), F.col("loan_amount")), 6)
    net_worth = F.coalesce("turnover", F.lit(10_000_000)).cast("decimal(18,2)") * dec("0.3", "decimal(2,1)")
    fixed = {
        "delinquency_two_years": 0.0, "inquiries_six_months": 0.0, "open_accounts": 5.0, "public_record": 0.0,
        "total_accounts": 10.0, "revolving_balance": 0.0, "revolving_utilities": 50.0, "total_current_balance": 0.0,
        "total_revolving_credit_limit": 0.0,
    }
    return applications.select(
        "company_id",
        F.coalesce("loan_amount", F.lit(5_000_000)).cast("decimal(18,2)").alias("loan_amount_requested"),
        F.coalesce("interest_rate", dec("11.0")).cast("decimal(10,2)").alias("interest_rate"),
        F.lower(F.coalesce("collateral_type", F.lit("immovable"))).alias("collateral_type"),
        coverage.cast("decimal(20,6)").alias("collateral_coverage"),
        F.lit("positive").alias("sector_outlook"),
        *[(F.coalesce(F.col(c).cast("decimal(20,6)"), dec(v, "decimal(20,6)")) if c in stated else dec(v, "decimal(20,6)")).alias(c)
          for c, v in RATIO_DEFAULTS.items()],
        net_worth.cast("decimal(24,2)").alias("net_worth"),
        *[F.lit(v).alias(c) for c, v in fixed.items()],
        *keep,
    )


PDF_FIELDS = ["debt_service_coverage", "current_ratio", "debt_to_equity", "net_worth"]
SHEET_FIELDS = ["debt_service_coverage", "current_ratio", "debt_to_equity", "revenue_growth", "net_worth", "revenue"]
LAKH = 100_000


def merge_facts(base: DataFrame, facts: DataFrame) -> DataFrame:
    """Financial rows with positive document facts laid over the defaults; later documents win.

    ``facts`` has company_id, source_kind (pdf or sheet), doc_order (integer), field, value. Net worth read
    from page text is in lakhs; spreadsheet revenue becomes turnover. A fact too large for its field keeps the
    default and is counted in ``n_unusable_facts``.
    """
    kind, field, value = F.col("source_kind"), F.col("field"), F.col("value")
    wanted = ((kind == "pdf") & field.isin(PDF_FIELDS)) | ((kind == "sheet") & field.isin(SHEET_FIELDS))
    scaled = F.when((kind == "pdf") & (field == "net_worth"), value * LAKH).otherwise(value)
    usable = facts.where(wanted & (value > 0)).select("company_id", "doc_order", "field", scaled.alias("value"))
    latest = usable.groupBy("company_id").agg(*[
        F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("doc_order"))).alias(f"_{f}")
        for f in SHEET_FIELDS
    ])
    types = dict(base.dtypes)
    over = {f: F.coalesce(F.col(f"_{f}").try_cast(types[f]), F.col(f)) for f in SHEET_FIELDS if f in types}
    unusable = sum((F.when(F.col(f"_{f}").isNotNull() & F.col(f"_{f}").try_cast(types[f]).isNull(), 1).otherwise(0) for f in over), F.lit(0))
    joined = base.join(latest, "company_id", "left").withColumn("n_unusable_facts", unusable.cast("bigint"))
    joined = joined.withColumns(over).withColumn("turnover", F.col("_revenue"))
    return joined.drop(*[f"_{f}" for f in SHEET_FIELDS])


def model_features(financials: DataFrame, key: str = "company_id") -> DataFrame:
    """The twelve model inputs as doubles, defaults for what is missing."""
    present = set(financials.columns)

    def feature(name: str) -> Column:
        source = "loan_amount_requested" if name == "loan_amount" and "loan_amount_requested" in present else name
        default = F.lit(fv.FEATURE_DEFAULTS[name])
        return (F.coalesce(F.col(source).cast("double"), default) if source in present else default).alias(name)

    return financials.select(key, *[feature(f) for f in fv.MODEL_FEATURES])


def _clamp(c: Column, low: Column | int = 0, high: Column | int = 100) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.greatest(as_col(low), F.least(as_col(high), c))


def _step(cond: Column, yes: int, no: int) -> Column:
    return F.when(cond, yes).otherwise(no)


def _or(name: str, default: str | int) -> Column:
    return F.coalesce(F.col(name), dec(default))


def five_cs(cases: DataFrame) -> DataFrame:
    """Adds the five factor scores. Comparisons are strict; missing inputs take their defaults."""
    capacity = (F.lit(50) + _step(_or("debt_service_coverage", 1) > dec("1.5"), 10, -10)
                + _step(_or("current_ratio", 1) > dec("1.2"), 10, -10)
                + _step(_or("revenue_growth", 0) > dec("0.1"), 10, -5))
    capital = (F.lit(50) + _step(_or("debt_to_equity", 2) < dec("1.5"), 20, -20) + _step(_or("net_worth", 0) > 0, 10, -20))
    collateral = (F.lit(50) + _step(_or("collateral_coverage", 0) > dec("1.2"), 20, -10)
                  + _step(F.coalesce(F.col("collateral_type") == "immovable", F.lit(False)), 10, 0))
    conditions = (F.lit(50) + _step(F.coalesce(F.col("sector_outlook") == "positive", F.lit(False)), 20, -20)
                  + _step(F.coalesce(F.col("gst_risk_level") == "low", F.lit(False)), 10, -10))
    return cases.withColumns({
        "character": rating_score(F.col("risk_rating")).cast("int"),
        "capacity": _clamp(capacity).cast("int"),
        "capital": _clamp(capital).cast("int"),
        "collateral": _clamp(collateral).cast("int"),
        "conditions": _clamp(conditions).cast("int"),
    })


def five_cs_weighted() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * dec(w, "decimal(3,2)") for c, w in fv.FIVE_CS_WEIGHTS.items()]).cast("decimal(10,2)")


def clamp_probability(p: Column, high: int) -> Column:
    return _clamp(p.cast("decimal(10,2)"), dec(8), dec(high))


def blend_score(df: DataFrame) -> DataFrame:
    """Half rule score, half model score; the default probability is bounded again before it is used."""
    p = clamp_probability(clamp_probability(F.col("default_probability"), 80), 75)
    df = df.withColumns({"default_probability": p.cast("decimal(10,2)"), "rule_score": five_cs_weighted()})
    df = df.withColumn("ml_score", (F.lit(100) - F.col("default_probability")).cast("decimal(10,2)"))
    half = dec("0.5", "decimal(2,1)")
    blended = F.round(F.col("rule_score") * half + F.col("ml_score") * half, 2)
    return df.withColumn("weighted_score", blended.cast("decimal(10,2)"))


def decide(df: DataFrame) -> DataFrame:
    """Decision, limit and premium after the two score caps."""
    cap = dec(64)
    score = F.col("weighted_score")
    score = F.when(F.coalesce(F.col("gst_risk") == "high", F.lit(False)), F.least(score, cap)).otherwise(score)
    score = F.when(_or("debt_to_equity", 0) > 3, F.least(score, cap)).otherwise(score)
    df = df.withColumn("score", score.cast("decimal(10,2)"))
    s = F.col("score")
    loan = F.coalesce(F.col("loan_amount_requested"), F.lit(1_000_000)).cast("decimal(18,2)")
    approve, conditional = s >= 80, s >= 45
    share = F.least(dec(1, "decimal(5,4)"), (s * dec("0.01", "decimal(2,2)")).cast("decimal(10,4)"))
    limit = (
        F.when(approve, F.round(loan * share, 2))
        .when(conditional, F.round(loan * dec("0.6", "decimal(2,1)"), 2))
        .otherwise(dec(0))
    )
    rest = F.lit(100) - s
    premium = F.when(approve, F.round(dec("8.5") + rest * dec("0.1", "decimal(2,1)"), 2)).when(
        conditional, F.round(dec(10) + rest * dec("0.15", "decimal(3,2)"), 2))
    return df.withColumns({
        "decision": F.when(approve, "APPROVE").when(conditional, "CONDITIONAL APPROVE").otherwise("REJECT"),
        "credit_limit": limit.cast("decimal(20,2)"),
        "risk_premium": premium.cast("decimal(10,2)"),
    })


def override_blacklisted(df: DataFrame) -> DataFrame:
    """Blacklisted companies are rejected; their score is kept."""
    hit = F.coalesce(F.col("blacklisted"), F.lit(False))
    return df.withColumns({
        "decision": F.when(hit, "REJECT").otherwise(F.col("decision")),
        "credit_limit": F.when(hit, dec(0)).otherwise(F.col("credit_limit")).cast("decimal(20,2)"),
        "risk_premium": F.when(~hit, F.col("risk_premium")),
    })


def early_warnings(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "early_warnings": texts_where(
            (F.coalesce("discrepancy_pct", F.lit(0.0)) > 40, fv.WARN_GST),
            (_or("debt_to_equity", 0) > 2, fv.WARN_LEVERAGE),
            (F.coalesce(F.col("blacklisted"), F.lit(False)), fv.WARN_BLACKLIST),
        ),
        "officer_review": F.coalesce(F.col("score").between(45, 65), F.lit(False)),
    })


def five_cs_long(scores: DataFrame) -> DataFrame:
    """One row per factor with its band."""
    long = scores.unpivot("company_id", FACTORS, "factor", "score")
    return long.select("company_id", F.initcap("factor").alias("parameter"), "score", rating_band(F.col("score")).alias("rating"))


def assemble_case(financials: DataFrame, gst: DataFrame, research: DataFrame, blacklist: DataFrame | None = None,
                  ml: DataFrame | None = None) -> DataFrame:
    """One row per company for scoring; every input has at most one row per company, so the joins are even.

    ``blacklist`` holds (company_id, blacklisted, n_matches), ``ml`` (company_id, default_probability); a
    probability may also be a column of ``financials``.
    """
    cases = financials.join(gst.select("company_id", "gst_revenue", "bank_credits", "discrepancy_pct", F.col("flags").alias("gst_flags"),
                                       F.col("risk_level").alias("gst_risk_level")), "company_id", "left").join(research, "company_id", "left")
    if blacklist is not None:
        cases = cases.join(blacklist.select("company_id", "blacklisted", "n_matches"), "company_id", "left")
    else:
        cases = cases.withColumns({"blacklisted": F.lit(False), "n_matches": F.lit(0).cast("bigint")})
    if ml is not None:
        cases = cases.join(ml.select("company_id", "default_probability"), "company_id", "left")
    level = F.coalesce("gst_risk_level", F.lit("low"))
    return cases.withColumns({
        "discrepancy_pct": F.coalesce("discrepancy_pct", F.lit(0.0)),
        "gst_risk_level": level,
        "gst_risk": level,
        "risk_rating": F.coalesce("risk_rating", F.lit("medium")),
        "blacklisted": F.coalesce("blacklisted", F.lit(False)),
        "n_matches": F.coalesce("n_matches", F.lit(0).cast("bigint")),
        "quota_warnings": F.coalesce("quota_warnings", F.array().cast("array<string>")) if "quota_warnings" in cases.columns else F.array().cast("array<string>"),
        "default_probability": F.coalesce(F.col("default_probability").cast("decimal(10,2)"), dec(fv.UNSCORED["default_probability"])),
    })
