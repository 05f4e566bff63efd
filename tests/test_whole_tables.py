"""The queries over whole tables read every line item, page and order; their rows are compared with SQL in test_queries."""

from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.operators import classify
from creditloom.plans import fixtures as fx
from creditloom.plans.registry import QUERIES


def test_every_line_is_a_sheet_row(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    assert QUERIES["header_row"](spark, sf).count() == 4 * lines.count()
    sheets = QUERIES["raw_preview"](spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["n"] for r in sheets} == {20}
    assert QUERIES["column_extract"](spark, sf).select("doc_id").distinct().count() == len(sheets)


def test_every_order_and_page(spark, sf):
    orders = fx.table(spark, sf, "orders")
    assert QUERIES["borrower_history"](spark, sf).where("found").count() == orders.count()
    types = {r["auto_type"]: r["n"] for r in QUERIES["apply_overrides"](spark, sf).groupBy("auto_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(types.values()) == orders.select("o_custkey").distinct().count()


def test_document_type_is_that_of_the_joined_pages(spark):
    """For every two rules, also those that share a type, one on each page."""
    words = [w[-1] for _, w in fv.CONTENT_RULES] + ["nothing"]
    texts = [(k, [a, b]) for k, (a, b) in enumerate((a, b) for a in words for b in words)]
    pages = spark.createDataFrame([(k, n, t) for k, both in texts for n, t in enumerate(both)], "doc_id long, page_no int, text string")
    whole = spark.createDataFrame([(k, "upload", "\n".join(both)) for k, both in texts], "doc_id long, name string, text string")
    want = {r["doc_id"]: r["doc_type"] for r in classify.classify_docs(whole, "name", "text").collect()}
    assert {r["doc_id"]: r["doc_type"] for r in classify.classify_pages(pages).collect()} == want
