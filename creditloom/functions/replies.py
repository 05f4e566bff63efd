"""Reading JSON replies as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "```json|```", ""), r"^\s+|\s+$", "")


def parse_fenced(c: Column) -> Column:
    """JSON once code fences are removed, else null."""
    return F.try_parse_json(strip_fences(c))


def parse_reply(c: Column) -> Column:
    """As ``parse_fenced``, but also accepts prose around the outermost braces."""
    clean = strip_fences(c)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(F.regexp_extract(clean, r"(?s)\{.*\}", 0)))


def text_at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def rating_text(reply: Column) -> Column:
    """External risk rating of a research reply, lower-cased; "high" when the reply is not JSON."""
    v = parse_fenced(reply)
    rating = (
        F.when(_has(v, "overall_external_risk_rating"), text_at(v, "overall_external_risk_rating"))
        .when(_has(v, "overall_risk"), text_at(v, "overall_risk"))
        .otherwise("medium")
    )
    return F.when(v.isNull(), "high").otherwise(F.trim(F.lower(rating)))


def rating_score(rating: Column) -> Column:
    scores = F.lit(fv.OTHER_RATING_SCORE)
    for name, score in reversed(list(fv.RATING_SCORES.items())):
        scores = F.when(rating == name, score).otherwise(scores)
    return scores


def early_signals(reply: Column) -> Column:
    """Early-warning texts of a reply as an array; null when the key is missing or not a list."""
    return F.try_variant_get(parse_fenced(reply), "$.early_warning_signals_if_any", "array<string>")
