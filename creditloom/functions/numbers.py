"""Parsing and display of amounts. Rounding is half-up on decimals; doubles appear only at the very end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_value(c: Column) -> Column:
    """Messy cell text to a number: brackets mean negative, signs and letters are dropped, junk gives null."""
    text = F.replace(F.replace(F.trim(c), F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")


def money(c: Column) -> Column:
    return c.try_cast("decimal(20,2)")


def half_up(c: Column, digits: int) -> Column:
    """Round a decimal half-up and return a double."""
    return F.round(c, digits).cast("double")


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole as an unrounded decimal; null when ``whole`` is zero."""
    part, whole = part.cast("decimal(24,2)"), whole.cast("decimal(24,2)")
    return (part / F.nullif(whole, F.lit(0).cast("decimal(24,2)"))) * F.lit(100)


def grouped(c: Column, digits: int) -> Column:
    """Thousands-grouped text of a decimal, rounded half-up."""
    return F.format_number(F.round(c, digits), digits)


def format_inr(c: Column) -> Column:
    """Rupee text in crores, lakhs or grouped units; N/A for missing values."""
    v = money(c)
    crores = F.round(v * F.lit("0.0000001").cast("decimal(8,7)"), 2).cast("string")
    lakhs = F.round(v * F.lit("0.00001").cast("decimal(6,5)"), 2).cast("string")
    return (
        F.when(v.isNull(), "N/A")
        .when(v >= 10_000_000, F.concat(F.lit("₹"), crores, F.lit(" Cr")))
        .when(v >= 100_000, F.concat(F.lit("₹"), lakhs, F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), grouped(v, 0)))
    )


def metric_display(c: Column) -> Column:
    """Tile text for one extracted metric; values that are not numbers are shown as they are."""
    v = c.try_cast("decimal(28,6)")
    return (
        F.when(v.isNull(), c.cast("string"))
        .when(v > 100_000, format_inr(v))
        .when(v < 10, F.round(v, 2).cast("decimal(28,2)").cast("string"))
        .otherwise(grouped(v, 1))
    )


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
