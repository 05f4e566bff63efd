"""Financial fields from spreadsheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions.numbers import clean_value
from creditloom.functions.rules import field_mask, field_of, fields_in
from creditloom.sources.cells import leading_sheets

ENOUGH_FIELDS = 3
KV_MAX_WIDTH = 3


def _filled() -> Column:
    return F.filter("cells", lambda c: c.value.isNotNull() & (F.trim(c.value) != ""))


def kv_by_sheet(rows: DataFrame, match: str = "first", max_sheets: int | None = None, max_width: int = KV_MAX_WIDTH) -> DataFrame:
    """Label/value rows of sheets with at most ``max_width`` columns; later rows win.

    Labels are resolved inside the row, so only (document, sheet, field) partial results are shuffled.
    The ordering column is a plain integer, which keeps the aggregation hash-based.
    """
    pairs = leading_sheets(rows, max_sheets).select(
        "doc_id", "sheet_no", "row_no", _filled().alias("_f"),
        (F.array_max("cells.col_no") + 1).alias("_width"),
    ).select(
        "doc_id", "sheet_no", "row_no", "_width",
        F.when(F.size("_f") >= 2, F.lower(F.trim(F.col("_f")[0].value))).alias("_label"),
        F.when(F.size("_f") >= 2, clean_value(F.element_at("_f", -1).value)).alias("value"),
    )
    field = F.when(F.col("value").isNotNull(), field_of("_label", match))
    per_sheet = pairs.groupBy("doc_id", "sheet_no", field.alias("field")).agg(
        F.max_by("value", "row_no").alias("value"), F.max("_width").alias("_width"))
    # At most one row per field remains in a sheet here.
    width = F.max("_width").over(Window.partitionBy("doc_id", "sheet_no"))
    return (
        per_sheet.withColumn("_sheet_width", width)
        .where((F.col("_sheet_width") <= max_width) & F.col("field").isNotNull())
        .select("doc_id", "sheet_no", "field", "value")
    )


def kv_extract(rows: DataFrame, match: str = "first", max_sheets: int | None = None) -> DataFrame:
    """Label/value fields of a document; later sheets win."""
    return merge_last(kv_by_sheet(rows, match, max_sheets), "sheet_no")


def _looks_like_header() -> Column:
    return F.size(F.filter("cells", lambda c: c.value.isNotNull() & c.is_text)) >= 2


def header_rows(rows: DataFrame) -> DataFrame:
    """Per sheet the first row with two or more filled cells of which two or more are text, else row zero."""
    return rows.groupBy("doc_id", "sheet_no").agg(
        F.coalesce(F.min(F.when(_looks_like_header(), F.col("row_no"))), F.lit(0)).alias("header_row"))


def header_names(rows: DataFrame) -> DataFrame:
    """The header row of every sheet that has one, with its names by column; of cells that repeat a column the first counts.

    Partial results hold one candidate row each, so a sheet of any length sends a row per task.
    """
    names = F.transform("cells", lambda c: F.struct(c.col_no.alias("col_no"), _column_name(c.value).alias("name")))
    first = rows.where(_looks_like_header()).groupBy("doc_id", "sheet_no").agg(F.min(F.struct("row_no", names.alias("names"))).alias("_h"))
    numbers = F.transform("_h.names", lambda n: n.col_no)
    unique = F.filter("_h.names", lambda n, i: F.array_position(numbers, n.col_no) == i + 1)
    return first.select("doc_id", "sheet_no", F.col("_h.row_no").alias("header_row"), unique.alias("_names"))


def _column_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def promote_header(rows: DataFrame) -> DataFrame:
    """Long data cells below the header row with the promoted column names; row zero is never promoted.

    One hash join brings a sheet's header row number and names to its rows, which are not sorted for it; adaptive execution splits a sheet
    that holds a large share of all rows, and the names are looked up inside the row. Keys are compared with nulls and rows without a
    document or sheet set aside afterwards: a plain comparison filters the headers' rows below their shuffle, which then serves one side only.
    """
    known = header_names(rows).where("header_row > 0").select(F.col("doc_id").alias("_doc"), F.col("sheet_no").alias("_sheet"), "header_row", "_names")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("sheet_no").eqNullSafe(F.col("_sheet"))
    whole = F.col("doc_id").isNotNull() & F.col("sheet_no").isNotNull()
    data = rows.join(known.hint("shuffle_hash"), same, "left").withColumns({c: F.when(whole, F.col(c)) for c in ("header_row", "_names")})
    data = data.where(F.col("header_row").isNull() | (F.col("row_no") > F.col("header_row")))
    cells = data.select("doc_id", "sheet_no", "row_no", F.map_from_entries("_names").alias("_by_column"), F.inline("cells"))
    return cells.select(
        "doc_id", "sheet_no", "row_no", "col_no",
        F.when(F.col("_by_column").isNotNull(), F.try_element_at("_by_column", F.col("col_no"))).otherwise(F.col("header")).alias("header"), "value", "is_text",
    )


def columns_by_sheet(rows: DataFrame, max_sheets: int | None = None) -> DataFrame:
    """First non-zero number of every column whose header names a field; later columns win.

    The fields a header feeds travel as a bit mask, so header and first number of a column come from one
    hash aggregation and data rows never meet the header row in a join.
    """
    promoted = F.col("header_row") > 0
    # Columns of unpromoted sheets whose own header feeds no field end here, before their cells are read.
    # The join is a plain inner one, so a sheet that holds a large share of all rows is split by adaptive execution.
    leading = leading_sheets(rows, max_sheets)
    cells = leading.join(header_rows(leading), ["doc_id", "sheet_no"]).select(
        "doc_id", "sheet_no", "row_no", "header_row", F.inline("cells")).where(promoted | (F.col("header_fields") != 0))
    is_header = promoted & (F.col("row_no") == F.col("header_row"))
    is_data = ~promoted | (F.col("row_no") > F.col("header_row"))
    cells = cells.withColumns({
        "_name": F.when(is_header, _column_name(F.col("value"))), "_number": F.when(is_data, clean_value(F.col("value")))})
    usable = F.when(F.col("_number") != 0, F.col("row_no"))
    fields = F.when(F.col("_name").isNotNull(), field_mask("_name")).when(~promoted, F.col("header_fields"))
    columns = cells.groupBy("doc_id", "sheet_no", "col_no").agg(
        F.bit_or(fields).alias("_fields"),
        F.min_by("_number", usable).alias("value"),
    )
    named = columns.where(F.col("value").isNotNull() & (F.col("_fields") != 0)).select(
        F.explode(fields_in("_fields")).alias("field"), "doc_id", "sheet_no", "col_no", "value")
    return merge_last(named, "col_no", ("doc_id", "sheet_no", "field"))


def column_extract(rows: DataFrame) -> DataFrame:
    """Header-column fields of a document; later sheets win."""
    return merge_last(columns_by_sheet(rows), "sheet_no")


def sheet_facts(rows: DataFrame, match: str = "first") -> DataFrame:
    """All fields of a document: within a sheet header columns override label rows, later sheets override both."""
    labels = kv_by_sheet(rows, match).withColumn("layer", F.col("sheet_no") * 2)
    columns = columns_by_sheet(rows).withColumn("layer", F.col("sheet_no") * 2 + 1)
    return merge_last(labels.unionByName(columns), "layer")


def merge_last(facts: DataFrame, order: str, keys: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """The last non-null value of every field along an integer order (pages, layers or documents)."""
    return facts.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def doc_fields(spark, edits: dict[str, str] | None = None) -> DataFrame:
    """Fields kept per document type; edits are newline-separated lists, trimmed, blanks dropped."""
    kept = dict(fv.DOC_FIELDS)
    for doc_type, text in (edits or {}).items():
        kept[doc_type] = [f.strip() for f in text.split("\n") if f.strip()]
    return spark.createDataFrame([(t, f) for t, fields in kept.items() for f in fields], "doc_type string, field string")


def schema_lookup(types: DataFrame) -> DataFrame:
    """(doc_type, field) rows for the given types; unknown types get the two general fields."""
    default = F.array(*[F.lit(f) for f in fv.OTHER_TYPE_FIELDS])
    fields = default
    for doc_type, names in fv.DOC_FIELDS.items():
        fields = F.when(F.col("doc_type") == doc_type, F.array(*[F.lit(f) for f in names])).otherwise(fields)
    return types.select("doc_type").distinct().select("doc_type", F.posexplode(fields).alias("ord", "field"))


def edited_fields(text: Column) -> Column:
    """A user-edited field list: one per line, trimmed, blank lines dropped."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def filter_schema(facts: DataFrame, doc_fields: DataFrame) -> DataFrame:
    """Facts whose field is configured for their document type; types without a list keep the general fields.

    The configuration is a handful of document types with a fixed dictionary of fields, so it is broadcast.
    """
    known = F.broadcast(doc_fields.select("doc_type", "field").distinct())
    listed = facts.join(known, ["doc_type", "field"], "left_semi")
    types = F.broadcast(doc_fields.select("doc_type").distinct())
    other = facts.join(types, "doc_type", "left_anti").where(F.col("field").isin(fv.OTHER_TYPE_FIELDS))
    return listed.unionByName(other)


def sheet_confidence(facts: DataFrame) -> DataFrame:
    """Whether the rules found enough fields of a workbook, or a model has to assist."""
    n = F.countDistinct("field")
    return facts.groupBy("doc_id").agg(
        n.alias("n_fields"), F.when(n >= ENOUGH_FIELDS, "rule_based").otherwise("needs_assistance").alias("method"))
