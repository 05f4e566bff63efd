"""Header CSV files, warehouse tables, column checks and record export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REQUIRED_COLUMNS = {"gst": ["taxable_value"], "bank": ["amount", "transaction_type"]}


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV. Pass a schema for large inputs: inference reads the file twice. A missing path raises."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def to_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Every row as one JSON text; stays distributed, iterate with ``toLocalIterator`` if needed."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def _first(df: DataFrame, order_by: list[str], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order_by).limit(n)


def load_or_fallback(spark: SparkSession, table: str, path: str, order_by: list[str], n: int | None = None) -> DataFrame:
    """A catalog table, or the file when there is no such table.

    ``n`` asks for the first rows of the table by ``order_by``; without it the whole table is returned.
    """
    if spark.catalog.tableExists(table):
        return _first(spark.table(table), order_by, n)
    return read_table(spark, path)


def load_jdbc_or_fallback(spark: SparkSession, options: dict[str, str], path: str, order_by: list[str], n: int | None = None) -> DataFrame:
    """As ``load_or_fallback`` for an outside warehouse reached over JDBC; empty options mean the file."""
    if options:
        return _first(spark.read.format("jdbc").options(**options).load(), order_by, n)
    return read_table(spark, path)


def is_valid(df: DataFrame, kind: str) -> bool:
    return set(REQUIRED_COLUMNS[kind]) <= set(df.columns)


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Row count and whether the columns required for ``kind`` are present."""
    return df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.lit(is_valid(df, kind)).alias("valid"))


def load_and_validate(spark: SparkSession, gst_path: str, bank_path: str) -> dict[str, object]:
    gst, bank = read_table(spark, gst_path), read_table(spark, bank_path)
    return {"gst_valid": is_valid(gst, "gst"), "bank_valid": is_valid(bank, "bank"), "gst_df": gst, "bank_df": bank}
