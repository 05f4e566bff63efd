"""Published defaulter lists: CSV files with two header spellings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv

OVERFLOW = "_overflow"


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    """The lines of a list with their surplus fields in one more column; None when the file is absent.

    Anything else that keeps a list from being read is raised: an unread list must not pass for a clear one.
    """
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if _spelled(header, fv.DEFAULTER_HEADERS["name"]) is None:
        raise ValueError(f"{path} has no column of names; its first line reads {header}")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*header, OVERFLOW])
    # The extra column takes the first surplus field, so over-long lines can be told from short ones.
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_list(spark: SparkSession, path: str) -> DataFrame | None:
    """One list without its over-long lines; short lines are kept. None when the file is absent; ValueError without a header."""
    lines = _lines(spark, path)
    return None if lines is None else lines.where(F.col(OVERFLOW).isNull()).drop(OVERFLOW)


def rejected_lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    """``path, line`` for every over-long line that ``read_list`` leaves out, fields joined by commas; None when no list exists."""
    out = None
    for path in paths:
        lines = _lines(spark, path)
        if lines is not None:
            fields = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in lines.columns])
            rejected = lines.where(F.col(OVERFLOW).isNotNull()).select(F.lit(path).alias("path"), F.array_join(fields, ",").alias("line"))
            out = rejected if out is None else out.unionByName(rejected)
    return out


def _spelled(columns: Iterable[str], spellings: Iterable[str]) -> list[str] | None:
    """The columns that match one of the spellings, exact ones first, then those that differ in case or outer blanks."""
    columns = list(columns)
    exact = [s for s in spellings if s in columns]
    folded = {s.strip().casefold() for s in spellings}
    return [*exact, *[c for c in columns if c not in exact and c.strip().casefold() in folded]] or None


def union_lists(lists: Iterable[DataFrame]) -> DataFrame:
    """Bag union of lists whose headers may differ."""
    out = None
    for df in lists:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def unify_headers(df: DataFrame) -> DataFrame:
    """The four output columns, each taken from whichever spelling is present, in any case."""

    def pick(spellings: list[str]):
        present = [F.col(f"`{c}`").cast("string") for c in _spelled(df.columns, spellings) or []]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    return df.select(*[pick(spellings).alias(name) for name, spellings in fv.DEFAULTER_HEADERS.items()])


def load_defaulters(spark: SparkSession, paths: Iterable[str]) -> DataFrame | None:
    """All lists that exist, under one set of headers; None when none exists."""
    lists = [df for p in paths if (df := read_list(spark, p)) is not None]
    return union_lists(unify_headers(df) for df in lists) if lists else None
