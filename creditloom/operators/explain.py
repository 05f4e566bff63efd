"""Explanations, SWOT points and number styles for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.numbers import format_inr, grouped, title_label
from creditloom.functions.replies import early_signals, parse_fenced
from creditloom.operators.research import _filled
from creditloom.operators.scoring import collateral_coverage

FIRST_WARNINGS = 2


def plain(c: Column) -> Column:
    """A decimal as the shortest text with at least one fractional digit, whatever its size."""
    return F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")


def warnings_text(reply: Column) -> Column:
    signals = F.slice(early_signals(reply), 1, FIRST_WARNINGS)
    return F.when(F.size(signals) > 0, F.array_join(signals, ", ")).otherwise(fv.NO_WARNINGS)


def top_reason() -> Column:
    """The most important reason, by precedence."""
    pct, p = F.col("discrepancy_pct"), F.col("default_probability")
    return (
        F.when(F.coalesce(pct, F.lit(0.0)) > 40, F.concat(F.lit("a "), plain(pct), F.lit("% GST-bank discrepancy suggesting revenue inflation")))
        .when(F.col("character") < 40, fv.REASON_CHARACTER)
        .when(p > 50, F.concat(F.lit("ML model projects "), plain(p), F.lit("% default probability")))
        .when(F.col("capacity") >= 70, F.concat(F.lit("strong repayment capacity with DSCR of "), plain(F.col("debt_service_coverage")), F.lit("x")))
        .otherwise(F.concat(F.lit("overall credit score of "), plain(F.col("score")), F.lit("/100")))
    )


def explain(df: DataFrame) -> DataFrame:
    """Adds the explanation, the one-sentence reason and the first external warnings."""
    s = lambda c: F.col(c).cast("string")
    explanation = F.concat(
        F.lit("Credit decision: "), F.col("decision"), F.lit(" with score "), plain(F.col("score")), F.lit("/100. ML model projects "),
        plain(F.col("default_probability")), F.lit("% default probability. Five Cs — Character: "), s("character"),
        F.lit(", Capacity: "), s("capacity"), F.lit(", Capital: "), s("capital"), F.lit(", Collateral: "), s("collateral"),
        F.lit(", Conditions: "), s("conditions"), F.lit(". Manual review recommended."))
    premium = F.coalesce(F.concat(plain(F.col("risk_premium")), F.lit("%")), F.lit("N/A"))
    df = df.withColumns({"explanation": explanation, "top_reason": top_reason()})
    sentence = F.concat(
        F.lit("I "), F.lower("decision"), F.lit(" this loan because "), F.col("top_reason"), F.lit(". Final credit limit: ₹"),
        grouped(F.col("credit_limit"), 0), F.lit(" at "), premium, F.lit(" risk premium."))
    df = df.withColumn("reason_sentence", sentence)
    return df.withColumn("warnings_text", warnings_text(F.col("reply")) if "reply" in df.columns else F.lit(fv.NO_WARNINGS))


def swot_points(applications: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Three points per quadrant: from a usable reply, else from the templates. Long form, no shuffle without replies."""
    coverage = F.round(collateral_coverage(F.col("collateral_value"), F.col("loan_amount")), 1).cast("decimal(20,1)").cast("string")
    values = {"coverage": coverage, "sector": F.coalesce("sector", F.lit("")),
              "year": F.coalesce(F.col("incorporation_year").cast("string"), F.lit("N/A"))}
    df = applications.withColumn("_reply", F.lit(None).cast("string")) if replies is None else applications.join(
        replies.select("company_id", F.col("reply").alias("_reply")), "company_id", "left")
    v = parse_fenced(F.col("_reply"))

    def points(quadrant: str) -> Column:
        templates = F.array(*[_filled(t, **values) for t in fv.SWOT_TEMPLATES[quadrant]])
        given = F.coalesce(F.try_variant_get(v, f"$.{quadrant}", "array<string>"), F.array().cast("array<string>"))
        return F.when(v.isNull(), templates).otherwise(given)

    quadrants = F.array(*[F.struct(F.lit(q).alias("quadrant"), points(q).alias("points")) for q in fv.SWOT_TEMPLATES])
    return df.select("company_id", F.inline(quadrants)).select("company_id", "quadrant", F.posexplode("points").alias("point_no", "point"))


def percent_text(v: Column) -> Column:
    """A rate as percent; rates below one are taken as fractions."""
    return F.concat(F.round(F.when(v < 1, v * 100).otherwise(v), 1).cast("decimal(28,1)").cast("string"), F.lit("%"))


def ratio_text(v: Column) -> Column:
    return F.concat(F.round(v, 2).cast("decimal(28,2)").cast("string"), F.lit("x"))


def styled(field: str, value: Column) -> Column:
    """A financial value in the style of its field."""
    v = value.try_cast("decimal(28,6)")
    if field in fv.RUPEE_FIELDS:
        return format_inr(v)
    return percent_text(v) if field in fv.PERCENT_FIELDS else ratio_text(v)


def format_financials(facts: DataFrame) -> DataFrame:
    """(company_id, label, shown) for (company_id, field, value) rows, each field in its own style."""
    field, value = F.col("field"), F.col("value")
    v = value.try_cast("decimal(28,6)")
    shown = (
        F.when(v.isNull(), F.coalesce(value.cast("string"), F.lit("None")))
        .when(field.isin(fv.RUPEE_FIELDS), format_inr(v))
        .when(field.isin(fv.PERCENT_FIELDS), percent_text(v))
        .when(field.isin(fv.RATIO_FIELDS), ratio_text(v))
        .otherwise(value.cast("string"))
    )
    return facts.select("company_id", title_label(field).alias("label"), shown.alias("shown"))
