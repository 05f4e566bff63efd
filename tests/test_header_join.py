"""How a sheet's header reaches its rows."""

from creditloom.operators import sheets
from creditloom.sources import cells

SCHEMA = "doc_id int, sheet_no int, row_no int, col_no int, value string, is_text boolean"


def sheet(doc, no=0):
    rows = [("Title", None), ("Name", " Net Sales "), ("x", "5")]
    return [(doc, no, r, c, v, True) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]


def test_rows_without_document_or_sheet_keep_no_header(spark):
    found = sheets.promote_header(cells.rows_from_cells(spark.createDataFrame(sheet(1) + sheet(None) + sheet(2, None), SCHEMA)))
    got = sorted((str(r.doc_id), str(r.sheet_no), r.row_no, r.col_no, r.header, r.value) for r in found.collect())
    assert [g[2:] for g in got if g[0] == "1"] == [(2, 0, "name", "x"), (2, 1, "net sales", "5")]
    others = [g for g in got if g[0] != "1"]
    assert len(others) == 10 and all(g[4] is None for g in others)


def test_rows_are_grouped_by_one_shuffle(spark):
    """Both sides of the join used to group the cells by a shuffle of their own, as a filter on keys stood below one of them."""
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = sheets.promote_header(cells.rows_from_cells(spark.createDataFrame(sheet(1) + sheet(2), SCHEMA)))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    assert plan.count("ReusedExchange") == 1 and "SortMergeJoin" not in plan
