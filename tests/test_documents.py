"""Page and sheet extraction against plain Python over whole documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.operators import pages, sheets
from creditloom.sources import cells

SNIPPETS = ["total income", " 1,234.50", "\n", "  ", "pat ", "promoter", " hold 45", "% ", "par", " 90", " 2.5", "dpd", ": ", "61", "dpd 12 ", "net worth",
            "1.4.", "current ratio", "d/e ratio", "x" * 25, "suit filed", "overdue", "gross npa", ".25", "total debt,", ","]


def random_docs(seed, n_docs=60):
    rng = random.Random(seed)
    return {d: ["".join(rng.choice(SNIPPETS) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))] for d in range(n_docs)}


def frame(spark, docs):
    return spark.createDataFrame([(d, i + 1, t) for d, ps in docs.items() for i, t in enumerate(ps)], "doc_id int, page_no int, text string")


def whole(ps):
    return "".join(p + "\n" for p in ps).strip()


def first_matches(text):
    out = {}
    for field, pattern in fv.TEXT_PATTERNS.items():
        m = re.search(pattern, text.lower())
        if m:
            try:
                out[field] = float(m.group(1).replace(",", ""))
            except ValueError:
                pass
    return out


@pytest.mark.parametrize("seed, per_part", [(1, 1), (2, 2), (3, 3), (4, 64), (5, 1)])
def test_document_facts_do_not_depend_on_parts(spark, seed, per_part):
    docs = random_docs(seed)
    got = {}
    for r in pages.regex_facts(frame(spark, docs), pages_per_part=per_part).collect():
        got.setdefault(r.doc_id, {})[r.field] = r.value
    assert got == {d: f for d, ps in docs.items() if (f := first_matches("".join(p + "\n" for p in ps)))}


@pytest.mark.parametrize("per_part", [1, 3, 64])
def test_document_text_parts_join_to_the_whole(spark, per_part):
    docs = random_docs(9)
    parts = {}
    for r in pages.document_text(frame(spark, docs), pages_per_part=per_part).orderBy("doc_id", "part_no").collect():
        parts[r.doc_id] = parts.get(r.doc_id, "") + r.text
    assert parts == {d: t for d, ps in docs.items() if (t := whole(ps))}


def test_document_text_with_tables(spark):
    text = spark.createDataFrame([(1, 1, "A"), (1, 2, None)], "doc_id int, page_no int, text string")
    table = spark.createDataFrame([(1, 2, 0, 1, " y "), (1, 2, 0, 0, "x"), (1, 2, 1, 0, None), (1, 2, 1, 1, "z")],
                                  "doc_id int, page_no int, row_no int, col_no int, value string")
    assert pages.document_text(text, table).first().text == "A\n\nx | y\n | z"


@pytest.mark.parametrize("per_part", [1, 2, 64])
def test_bureau_flags(spark, per_part):
    docs = random_docs(11)
    docs[999] = ["dpd 1 dpd 2 dpd 3", "dpd 4", "dpd 5 dpd 99", "nothing"]
    docs[998] = ["dpd", "45"]
    docs[997] = ["dpd 12345678901234567890"]
    got = {r.doc_id: r for r in pages.bureau_flags(frame(spark, docs), pages_per_part=per_part).collect()}
    for d, ps in docs.items():
        t = "".join(p + "\n" for p in ps)
        found = re.findall(fv.DPD_PATTERN, t)
        r = got[d]
        if len(found) <= 5 and d != 997:
            want = [int(m) for m in found]
            assert r.dpd_values == want if per_part == 64 else set(r.dpd_values) == set(want), d
        assert r.cibil_risk == any(int(m) > 30 for m in found)
        assert r.has_dpd == (bool(found) or "overdue" in t or "days past due" in t)
        assert r.red_flags == [k for k in fv.BUREAU_RED_FLAGS if k in t]
    assert got[999].dpd_values == [1, 2, 3, 4, 5] and got[999].cibil_risk


def test_pages_merge_and_selection(spark):
    docs = {1: ["x" * 100] * 12, 2: ["y" * 100] * 4, 3: ["short"] * 9, 4: ["z" * 200] * 6}
    got = {}
    for r in pages.key_pages(frame(spark, docs)).collect():
        got.setdefault(r.doc_id, set()).add(r.page_no)
    # Document 1 has 300 characters on its first pages against 960, so it counts as scanned.
    assert got == {1: set(range(1, 9)), 3: set(range(1, 9)), 4: {1, 2, 3, 5, 6}, 2: set(range(1, 5))}
    facts = spark.createDataFrame([(1, "revenue", 5.0, 1), (1, "revenue", 7.0, 3), (1, "revenue", 6.0, 2), (1, "npa_pct", None, 4)],
                                  "doc_id int, field string, value double, page_no int")
    assert [tuple(r) for r in sheets.merge_last(facts.repartition(5), "page_no").collect()] == [(1, "revenue", 7.0)]


def sheet(spark, *grids, headers=None):
    rows = []
    for s, grid in enumerate(grids):
        for i, row in enumerate(grid):
            for c, v in enumerate(row):
                rows.append((1, s, i, c, headers[c] if headers else None, None if v is None else str(v), isinstance(v, str)))
    return cells.rows_from_cells(spark.createDataFrame(
        rows, "doc_id int, sheet_no int, row_no int, col_no int, header string, value string, is_text boolean"))


def facts(df):
    return {r.field: r.value for r in df.collect()}


def test_label_rows(spark):
    rows = sheet(spark, [["Total Revenue", "1,000"], ["Total Revenue", "(2,000)"], ["Debt to Equity", 1.5], ["Remarks", 9], ["Net Profit", "n/a"], [None, 4], ["npa", 0]])
    assert facts(sheets.kv_extract(rows)) == {"revenue": -2000.0, "net_worth": 1.5, "npa_pct": 0.0}
    assert facts(sheets.kv_extract(rows, "longest")) == {"revenue": -2000.0, "debt_to_equity": 1.5, "npa_pct": 0.0}


def test_label_rows_need_narrow_sheets_and_later_sheets_win(spark):
    wide = [["Revenue", 1, 2, 3]]
    assert facts(sheets.kv_extract(sheet(spark, wide))) == {}
    assert facts(sheets.kv_extract(sheet(spark, [["Revenue", 1]], [["Revenue", 2]], wide))) == {"revenue": 2.0}
    six = [[["Revenue", n]] for n in range(1, 7)]
    assert facts(sheets.kv_extract(sheet(spark, *six))) == {"revenue": 6.0}
    assert facts(sheets.kv_extract(sheet(spark, *six), max_sheets=5)) == {"revenue": 5.0}


def test_header_columns(spark):
    grid = [["Statement", None, None], ["Item", " Net Sales ", "EBITDA"], ["Q1", 0, "₹ 5"], ["Q2", 12, "-"]]
    assert facts(sheets.column_extract(sheet(spark, grid))) == {"revenue": 12.0, "gross_profit": 5.0, "ebitda": 5.0}
    # Row zero is never promoted, so a sheet that starts with its header has unnamed columns ...
    assert facts(sheets.column_extract(sheet(spark, grid[1:]))) == {}
    # ... unless the file itself names them.
    named = sheet(spark, grid[2:], headers=["Item", "Net Sales", "EBITDA"])
    assert facts(sheets.column_extract(named)) == {"revenue": 12.0, "gross_profit": 5.0, "ebitda": 5.0}


def test_sheet_facts_layers(spark):
    labels = [["Revenue", 7]]
    columns = [["t", None], ["Revenue", "Other"], [3, 4]]
    assert facts(sheets.sheet_facts(sheet(spark, labels, columns))) == {"revenue": 3.0}
    assert facts(sheets.sheet_facts(sheet(spark, columns, labels))) == {"revenue": 7.0}


def test_schema_filter(spark):
    df = spark.createDataFrame([(1, "ALM", "revenue", 1.0), (1, "ALM", "total_assets", 2.0), (2, "Nope", "revenue", 3.0), (2, "Nope", "npa_pct", 4.0)],
                               "doc_id int, doc_type string, field string, value double")
    got = {(r.doc_id, r.field) for r in sheets.filter_schema(df, sheets.doc_fields(spark)).collect()}
    assert got == {(1, "total_assets"), (2, "revenue")}


def test_previews(spark):
    rows = sheet(spark, [[f"r{i}", None] for i in range(30)], headers=["a", "b"])
    assert cells.file_preview(rows).first().preview == "Columns: a, b\nSample rows:\nr0 | \nr1 | \nr2 | "
    assert cells.file_preview(rows, "xlsx").first().preview.count("\n") == 5
    assert cells.raw_preview(rows).count() == 20
    assert tuple(cells.shape_of(rows).select("n_rows", "n_cols").first()) == (30, 2)
    names = spark.createDataFrame([("a.PDF",), ("b.txt",)], "n string").select(cells.bare_preview(F.col("n"))).collect()
    assert [r[0] for r in names] == ["PDF document: a.PDF", "File: b.txt"]


def test_numeric_cells_keep_their_size(spark):
    from pyspark.sql import functions as F

    from creditloom.sources import cells

    values = [12_345_678.9, 25_000_000.0, 1e12, 0.0005, -0.25, 0.0, 7.0]
    df = spark.createDataFrame([(i, "Total Revenue", v, int(v)) for i, v in enumerate(values)], "n long, label string, amount double, whole long")
    got = {r["doc_id"]: r["value"] for r in sheets.kv_extract(
        cells.to_sheet_rows(df, F.col("n"), F.lit(0), ["label", "amount"], with_header=False)).collect()}
    assert got == dict(enumerate(values))
    texts = [r["value"] for r in cells.to_cells(df, F.col("n"), F.lit(0), ["amount"]).orderBy("doc_id").collect()]
    assert texts == ["12345678.9", "25000000", "1000000000000", "0.0005", "-0.25", "0", "7"]
    whole = {r["doc_id"]: r["value"] for r in sheets.kv_extract(
        cells.to_sheet_rows(df, F.col("n"), F.lit(0), ["label", "whole"], with_header=False)).collect()}
    assert whole == {i: float(int(v)) for i, v in enumerate(values)}


def test_matches_behind_characters_of_two_units_are_kept(spark):
    rows = [(1, 1, "\U0001F600" * 20 + " total assets 500"), (2, 1, "\u0130" * 20 + " total assets 500"), (3, 1, "total assets 500")]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, text string")
    for size in (1, 2, 64):
        got = {(r["doc_id"], r["field"], r["value"]) for r in pages.regex_facts(df, pages_per_part=size).collect()}
        assert got == {(r["doc_id"], r["field"], r["value"]) for r in pages.page_facts(df).collect()} and len(got) == 3
