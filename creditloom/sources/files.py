"""Uploaded file sets: which extractor a file goes to and how complete a set is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 5


def extension(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), r"\."), -1)


def route_files(doc_files: DataFrame, path: str = "path") -> DataFrame:
    """Adds extension, extractor and, for unknown types, an error text."""
    ext = F.col("ext")
    extractor = (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin("xlsx", "xls"), "workbook")
        .when(ext == "csv", "csv")
        .when(ext.isin("jpg", "jpeg", "png"), "image")
        .otherwise("none")
    )
    error = F.when(F.col("extractor") == "none", F.concat(F.lit("Unsupported: "), ext))
    return doc_files.withColumn("ext", extension(F.col(path))).withColumn("extractor", extractor).withColumn("error", error)


def doc_completeness(doc_files: DataFrame, key: str = "company_id", slot: str = "doc_key") -> DataFrame:
    """Filled slots per company; at least one is needed to go on."""
    return doc_files.groupBy(key).agg(F.countDistinct(slot).alias("n_docs")).select(
        key, "n_docs",
        F.concat(F.col("n_docs").cast("string"), F.lit(f"/{SLOTS} DOCUMENTS UPLOADED")).alias("status"),
        (F.col("n_docs") >= 1).alias("can_proceed"),
    )
