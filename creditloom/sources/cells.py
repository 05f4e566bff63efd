"""Spreadsheet content as tables.

Two shapes are used: long ``cells`` (one row per cell) and ``sheet rows`` (one row per sheet row with its
cells as an array ordered by column). Row numbers start at zero within a sheet. Row-wise logic works on
sheet rows, where it needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.rules import field_mask, field_mask_of

# ``header_fields`` has a bit for every field the file's own header of the column feeds.
CELL = "array<struct<col_no:int,header:string,header_fields:bigint,value:string,is_text:boolean>>"
NUMERIC = ("byte", "short", "int", "bigint", "float", "double", "decimal", "tinyint", "smallint")


def plain_text(c: Column, kind: str) -> Column:
    """A value as text; floating-point numbers as digits without an exponent."""
    if not kind.startswith(("float", "double")):
        return c.cast("string")
    digits = F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.coalesce(F.when(c == 0, F.lit("0")), digits, c.cast("string"))


def _cell_array(df: DataFrame, columns: Sequence[str], with_header: bool) -> Column:
    types = dict(df.dtypes)
    return F.array(*[
        F.struct(
            F.lit(i).alias("col_no"),
            F.lit(c if with_header else None).cast("string").alias("header"),
            F.lit(field_mask_of(c) if with_header else 0).cast("bigint").alias("header_fields"),
            plain_text(F.col(c), types[c]).alias("value"),
            F.lit(not types[c].startswith(NUMERIC)).alias("is_text"),
        )
        for i, c in enumerate(columns)
    ]).cast(CELL)


def to_sheet_rows(df: DataFrame, doc_id: Column, row_no: Column, columns: Sequence[str],
                  sheet_no: int = 0, with_header: bool = True) -> DataFrame:
    """A table whose rows carry their own position, as sheet rows."""
    return df.select(
        doc_id.alias("doc_id"), F.lit(sheet_no).alias("sheet_no"), row_no.cast("int").alias("row_no"),
        _cell_array(df, columns, with_header).alias("cells"),
    )


def explode_cells(rows: DataFrame) -> DataFrame:
    """Sheet rows to long cells."""
    return rows.select("doc_id", "sheet_no", "row_no", F.inline("cells")).drop("header_fields")


def to_cells(df: DataFrame, doc_id: Column, row_no: Column, columns: Sequence[str], sheet_no: int = 0) -> DataFrame:
    """Any table as long cells with its column names as headers."""
    return explode_cells(to_sheet_rows(df, doc_id, row_no, columns, sheet_no))


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """Long cells to sheet rows; a group is one sheet row, so its size is the sheet's width. Cells without headers are shuffled without them."""
    named = "header" in cells.columns
    col_no = F.col("col_no").cast("int").alias("col_no")
    if named:
        cell = F.struct(col_no, "header", F.coalesce(field_mask("lower(header)"), F.lit(0).cast("bigint")).alias("header_fields"), "value", "is_text")
    else:
        cell = F.struct(col_no, "value", "is_text")
    found = F.array_sort(F.collect_list(cell))
    if not named:
        found = F.transform(found, lambda c: F.struct(
            c.col_no.alias("col_no"), F.lit(None).cast("string").alias("header"), F.lit(0).cast("bigint").alias("header_fields"), c.value.alias("value"), c.is_text.alias("is_text")))
    return cells.groupBy("doc_id", "sheet_no", "row_no").agg(found.cast(CELL).alias("cells"))


def leading_sheets(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The first ``most`` sheets of every workbook, or all of them."""
    return rows if most is None else rows.where(F.col("sheet_no") < most)


def _row_text(sep: str) -> Column:
    return F.array_join(F.transform("cells", lambda c: F.coalesce(c.value, F.lit(""))), sep)


def file_preview(rows: DataFrame, kind: str = "csv") -> DataFrame:
    """Short text per document: headers and the first three rows of a CSV, or the first five rows of a workbook.

    Groups hold at most that many rows because the row filter comes first.
    """
    n = 3 if kind == "csv" else 5
    head = rows.where((F.col("sheet_no") == 0) & (F.col("row_no") < n))
    lines = F.array_sort(F.collect_list(F.struct("row_no", _row_text(" | ").alias("line")))).getField("line")
    if kind != "csv":
        return head.groupBy("doc_id").agg(
            F.concat(F.lit("Excel content preview:\n"), F.array_join(lines, "\n")).alias("preview"))
    headers = F.array_join(F.transform("cells", lambda c: c.header), ", ")
    return head.groupBy("doc_id").agg(
        F.concat(F.lit("Columns: "), F.min(headers), F.lit("\nSample rows:\n"), F.array_join(lines, "\n")).alias("preview"))


def bare_preview(name: Column) -> Column:
    """Preview of files that are not opened: their name."""
    pdf = F.lower(F.element_at(F.split(name, r"\."), -1)) == "pdf"
    return F.concat(F.when(pdf, "PDF document: ").otherwise("File: "), name)


def raw_preview(rows: DataFrame, n: int = 20) -> DataFrame:
    """First rows of every sheet with missing cells shown as empty text."""
    filled = F.transform("cells", lambda c: F.coalesce(c.value, F.lit("")))
    return rows.where(F.col("row_no") < n).select("doc_id", "sheet_no", "row_no", filled.alias("filled"))


def shape_of(rows: DataFrame) -> DataFrame:
    """Rows and columns of every sheet."""
    width = F.array_max(F.transform("cells", lambda c: c.col_no)) + 1
    return rows.groupBy("doc_id", "sheet_no").agg(
        (F.max("row_no") + 1).alias("n_rows"), F.max(width).alias("n_cols"))
