"""Column functions: literal inputs and the results expected of them."""

import pytest
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.functions import numbers, replies, rules
from creditloom.operators import classify, research, sheets
from creditloom.operators.scoring import rating_score


def one(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


@pytest.mark.parametrize("text, number", [
    ("1,234.50", 1234.5), ("(5,000)", -5000.0), ("₹ 12.5", 12.5), ("$3", 3.0), ("45.2%", 45.2), ("n/a", None), ("-", None), ("", None),
    (None, None), ("1.4.", None), ("abc 7", 7.0), ("0", 0.0), (" 8 ", 8.0), ("1-2", None), (".5", 0.5), ("5.", 5.0),
])
def test_clean_value(spark, text, number):
    assert one(spark, [(text,)], "t string", v=numbers.clean_value(F.col("t"))) == [(number,)]


@pytest.mark.parametrize("value, shown", [
    ("10000000", "₹1.00 Cr"), ("9999999.99", "₹100.00 L"), ("100000", "₹1.00 L"), ("99999.50", "₹100,000"), ("1234", "₹1,234"),
    ("-5000", "₹-5,000"), (None, "N/A"), ("0", "₹0"), ("123456789", "₹12.35 Cr"),
])
def test_format_inr(spark, value, shown):
    assert one(spark, [(value,)], "v string", s=numbers.format_inr(F.col("v"))) == [(shown,)]


@pytest.mark.parametrize("value, shown", [("1.4", "1.40"), ("9.999", "10.00"), ("45.25", "45.3"), ("1234.5", "1,234.5"), ("250000", "₹2.50 L"),
                                          ("-3", "-3.00"), ("Q4", "Q4")])
def test_metric_display(spark, value, shown):
    assert one(spark, [(value,)], "v string", s=numbers.metric_display(F.col("v"))) == [(shown,)]


@pytest.mark.parametrize("label, first, longest", [
    ("total revenue", "revenue", "revenue"), ("debt to equity", "net_worth", "debt_to_equity"), ("unsecured loans", "secured_debt", "unsecured_debt"),
    ("sales growth", "revenue", "revenue_growth"), ("ebitda", "gross_profit", "gross_profit"), ("remarks", None, None),
    ("stage ii assets", "stage_1_pct", "stage_2_pct"), ("shareholders' equity", "net_worth", "net_worth"),
])
def test_field_of_labels(spark, label, first, longest):
    got = one(spark, [(label,)], "l string", a=rules.field_of("l"), b=rules.field_of("l", "longest"))
    assert got == [(first, longest)]


def test_field_rules_equal_the_full_dictionary(spark):
    """Dropping redundant words changes no result: every keyword alone and every pair of keywords."""
    words = [w for ws in fv.FIELD_KEYWORDS.values() for w in ws]
    labels = words + [f"{a} {b}" for a in words[::3] for b in words[::5]]
    got = {r.l: (r.f, set(r.all)) for r in spark.createDataFrame([(w,) for w in set(labels)], "l string").select(
        "l", rules.field_of("l").alias("f"), rules.field_mask("l").alias("m")).select("l", "f", rules.fields_in("m").alias("all")).collect()}
    for label in labels:
        hits = [f for f, ws in fv.FIELD_KEYWORDS.items() if any(w in label for w in ws)]
        assert got[label] == (hits[0], set(hits))


@pytest.mark.parametrize("name, preview, kind", [
    ("ALM_2024.pdf", "", "ALM"), ("party_list.csv", "maturity", "Portfolio_Data"), ("BalanceSheet.xlsx", "npa", "Annual_Report"),
    ("x.csv", "Columns: GSTIN", "Portfolio_Data"), ("x.csv", "liquidity", "ALM"), ("x.csv", "pledge", "Shareholding_Pattern"),
    ("x.csv", "unsecured", "Borrowing_Profile"), ("x.csv", "stage 2", "Portfolio_Data"), ("x.csv", "ebitda", "Annual_Report"),
    ("x.csv", "transaction", "Borrowing_Profile"), ("x.csv", "nothing", "Annual_Report"), ("x.csv", None, "Annual_Report"),
])
def test_classify_docs(spark, name, preview, kind):
    docs = spark.createDataFrame([(name, preview)], "n string, p string")
    assert classify.classify_docs(docs, "n", "p").first().doc_type == kind


def test_prompt_fallbacks(spark):
    prompts = [("Classify this: shareholding",), ("Please give a SWOT",), ("Extract the fields",), ("hello",), ("classification of NPA",)]
    got = [r[0] for r in spark.createDataFrame(prompts, "p string").select(classify.fallback_reply("p")).collect()]
    assert got[0] == "Shareholding_Pattern" and got[4] == "Portfolio_Data"
    assert '"strengths"' in got[1] and got[2] == "{}" and '"overall_risk": "medium"' in got[3]


def test_detect_doc_type_breaks_ties_by_order(spark):
    docs = spark.createDataFrame([(1, "gap and promoter"), (2, "nothing"), (3, "NPA stage par portfolio")], "doc_id int, text string")
    got = {r.doc_id: (r.detected_type, r.score) for r in classify.detect_doc_type(docs, "doc_id").collect()}
    assert got == {1: ("ALM", 1), 2: ("ALM", 0), 3: ("Portfolio_Data", 4)}


@pytest.mark.parametrize("reply, rating, score", [
    ('```json\n{"overall_external_risk_rating": "Low"}\n```', "low", 90), ('{"overall_risk": " HIGH "}', "high", 30), ("{}", "medium", 60),
    ("no json", "high", 30), ('{"overall_external_risk_rating": "High — manual verification required"}', "high — manual verification required", 60),
    ('{"overall_external_risk_rating": null, "overall_risk": "high"}', None, 60), ('Sure: {"overall_risk": "low"}', "high", 30), (None, "high", 30),
])
def test_research_rating(spark, reply, rating, score):
    r = replies.rating_text(F.col("r"))
    assert one(spark, [(reply,)], "r string", a=r, b=rating_score(r)) == [(rating, score)]


def test_parse_reply_salvages_braces(spark):
    rows = [('Sure: {"a": {"b": 1}} done',), ("junk",), ('```json {"a": 2} ```',), ("",)]
    got = [r.a for r in spark.createDataFrame(rows, "r string").select(replies.text_at(replies.parse_reply(F.col("r")), "a").alias("a")).collect()]
    assert got == ['{"b":1}', None, "2", None]


def test_flatten_research_nested_lists(spark):
    reply = ('{"promoter_reputation": "fine", "sector_view": {"headwinds": ["a", "b"], "tail_winds": "[\'x\', \'y\']"}, "signals": [], '
             '"long": "' + "z" * 900 + '"}')
    rows = research.flatten_research(spark.createDataFrame([(1, reply), (2, "```json plain``` "), (3, "[1, 2]")], "company_id int, reply string"), research.LABEL_CHARS, research.FINDINGS_CHARS).collect()
    got = {(r.company_id, r.label): r.content for r in rows}
    assert got == {
        (1, "Promoter Reputation"): "fine", (1, "Sector View — Headwinds"): "a | b", (1, "Sector View — Tail Winds"): "x | y",
        (1, "Signals"): "", (1, "Long"): "z" * 800, (2, "Research Findings"): "plain",
    }


def test_small_list_helpers(spark):
    got = one(spark, [("A, , B ,",)], "p string", a=rules.split_promoters(F.col("p")), b=rules.slice_n(rules.split_promoters(F.col("p")), 1),
              c=rules.infer_sector(F.lit("Sharma Textiles")), d=rules.infer_sector(F.lit("Steel")), e=rules.is_credit(F.lit(None).cast("string")))
    assert got == [(["A", "B"], ["A"], "textile", "MSME", False)]
    edited = one(spark, [(" revenue \n\n npa_pct ",)], "t string", f=sheets.edited_fields(F.col("t")))
    assert edited == [(["revenue", "npa_pct"],)]
    assert sheets.doc_fields(spark, {"ALM": " lcr \n\nnsfr "}).where("doc_type = 'ALM'").count() == 2


def test_rounding_is_half_up(spark):
    got = one(spark, [("1.005",)], "v string", a=numbers.half_up(F.col("v").cast("decimal(10,3)"), 2))
    assert got == [(1.01,)]
