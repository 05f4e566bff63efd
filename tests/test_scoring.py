"""Scores, decisions, explanations, memos: a hand-computed applicant and properties over the whole book."""

import pytest
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.operators import explain, memo, scoring
from creditloom.plans import assessment
from creditloom.plans import fixtures as fx
from creditloom.plans import registry as reg

APPLICANT = """SELECT 1 AS company_id, 'Sharma Textiles Pvt Ltd' AS company_name, 'U51909DL2011PTC220073' AS cin, 'AABCS1234C' AS pan, 2011 AS incorporation_year,
    CAST(11.0 AS DECIMAL(10,2)) AS interest_rate, 'Textile' AS sector, 'Rajesh Sharma, Priya Sharma' AS promoter_names, 5000000L AS loan_amount,
    7500000L AS collateral_value, 'Immovable' AS collateral_type, 9820000L AS turnover, CAST(NULL AS DECIMAL(10,2)) AS default_probability"""


@pytest.fixture(scope="module")
def sample(spark):
    apps = spark.sql(APPLICANT)
    nothing = spark.createDataFrame([], "company_id int, taxable_value double, transaction_type string, amount double, reply string")
    done = assessment.assess(apps, nothing.select("company_id", "taxable_value"), nothing.select("company_id", "transaction_type", "amount"),
                             nothing.select("company_id", "reply"), None)
    return done.cache()


def test_sample_applicant(sample):
    r = sample.first()
    assert [r[c] for c in scoring.FACTORS] == [60, 25, 40, 80, 80]
    assert (float(r.rule_score), float(r.ml_score), float(r.score)) == (50.5, 65.0, 57.75)
    assert (r.decision, float(r.credit_limit), float(r.risk_premium)) == ("CONDITIONAL APPROVE", 3_000_000.0, 16.34)
    assert r.officer_review and r.early_warnings == []
    assert r.reason_sentence == ("I conditional approve this loan because overall credit score of 57.75/100. "
                                 "Final credit limit: ₹3,000,000 at 16.34% risk premium.")
    assert r.warnings_text == "None detected"


def test_sample_memo(sample, tmp_path):
    cases = sample.withColumn("sources", F.array(*[F.lit(f"u{i}") for i in range(7)]))
    rows = memo.memo_sections(cases, "01 January 2026")
    got = {(r.sec_no, r.label): r.value for r in rows.collect()}
    assert got[(1, "Loan Requested")] == "₹50.00 L" and got[(3, "Risk Premium")] == "16.34%"
    assert got[(5, "Collateral Coverage")] == "1.50x" and got[(5, "Interest Rate")] == "11.0%" and got[(5, "Revenue Growth")] == "10.0%"
    assert got[(7, "References & Data Sources")] == "u0, u1, u2, u3, u4"
    assert got[(8, "")] == fv.MEMO_NO_NOTES and got[(4, "Capacity")].startswith("Capacity (25/100 — Weak)")
    memo.write_memos(rows, str(tmp_path / "memos"))
    assert sample.sparkSession.read.parquet(str(tmp_path / "memos")).where("decision = 'CONDITIONAL APPROVE'").count() == rows.count()
    name = sample.select(memo.memo_name(F.col("company_name"), "20260101_000000").alias("n")).first().n
    assert name == "CAM_Sharma_Textiles_Pvt_Ltd_20260101_000000"


@pytest.mark.parametrize("score, debt, gst_risk, decision, limit, premium", [
    ("80.00", "1", "low", "APPROVE", 800_000.0, 10.5), ("87.25", "1", "low", "APPROVE", 872_500.0, 9.78), ("79.99", "1", "low", "CONDITIONAL APPROVE", 600_000.0, 13.0),
    ("45.00", "1", "low", "CONDITIONAL APPROVE", 600_000.0, 18.25), ("44.99", "1", "low", "REJECT", 0.0, None),
    ("85.00", "3", "low", "APPROVE", 850_000.0, 10.0), ("85.00", "3.1", "low", "CONDITIONAL APPROVE", 600_000.0, 15.4),
    ("85.00", "1", "high", "CONDITIONAL APPROVE", 600_000.0, 15.4), ("85.00", "1", "medium", "APPROVE", 850_000.0, 10.0),
])
def test_decision_bounds(spark, score, debt, gst_risk, decision, limit, premium):
    df = spark.createDataFrame([(1, score, debt, gst_risk, 1_000_000)], "company_id int, s string, d string, gst_risk string, loan_amount_requested int").selectExpr(
        "company_id", "CAST(s AS DECIMAL(10,2)) AS weighted_score", "CAST(d AS DECIMAL(20,6)) AS debt_to_equity", "gst_risk", "loan_amount_requested")
    r = scoring.decide(df).first()
    assert (r.decision, float(r.credit_limit), None if r.risk_premium is None else float(r.risk_premium)) == (decision, limit, premium)


def test_defaults_for_missing_inputs(spark):
    df = spark.sql("""SELECT 1 AS company_id, CAST(NULL AS DECIMAL(20,6)) AS debt_service_coverage, CAST(NULL AS DECIMAL(20,6)) AS current_ratio,
        CAST(NULL AS DECIMAL(20,6)) AS revenue_growth, CAST(NULL AS DECIMAL(20,6)) AS debt_to_equity, CAST(NULL AS DECIMAL(24,2)) AS net_worth,
        CAST(NULL AS DECIMAL(20,6)) AS collateral_coverage, CAST(NULL AS STRING) AS collateral_type, CAST(NULL AS STRING) AS sector_outlook,
        CAST(NULL AS STRING) AS gst_risk_level, CAST(NULL AS STRING) AS risk_rating""")
    r = scoring.five_cs(df).first()
    assert [r[c] for c in scoring.FACTORS] == [60, 25, 10, 40, 20]


def test_probability_is_bounded_twice(spark):
    df = spark.createDataFrame([(i, str(p)) for i, p in enumerate((1, 8, 35.5, 75, 79, 99))], "company_id int, p string").selectExpr(
        "company_id", "CAST(p AS DECIMAL(10,2)) AS default_probability", *[f"50 AS {c}" for c in scoring.FACTORS])
    got = [float(r.default_probability) for r in scoring.blend_score(df).orderBy("company_id").collect()]
    assert got == [8.0, 8.0, 35.5, 75.0, 75.0, 75.0]


def test_document_facts_override(spark):
    base = scoring.base_financials(spark.sql(APPLICANT))
    facts = spark.createDataFrame([
        (1, "pdf", 0, "net_worth", 12.0), (1, "pdf", 0, "revenue_growth", 0.9), (1, "pdf", 0, "current_ratio", -2.0), (1, "pdf", 1, "current_ratio", 1.8),
        (1, "sheet", 2, "current_ratio", 1.9), (1, "sheet", 3, "current_ratio", 0.0), (1, "sheet", 2, "revenue", 77.0), (2, "pdf", 0, "net_worth", 5.0),
    ], "company_id int, source_kind string, doc_order bigint, field string, value double")
    r = scoring.merge_facts(base, facts.repartition(4)).first()
    assert (float(r.net_worth), float(r.current_ratio), float(r.revenue_growth), r.turnover) == (1_200_000.0, 1.9, 0.1, 77.0)


def test_swot_uses_usable_replies(spark):
    apps = spark.sql(APPLICANT)
    points = {(r.quadrant, r.point_no): r.point for r in explain.swot_points(apps).collect()}
    assert points[("strengths", 0)] == "Collateral coverage at 1.5x provides downside protection" and len(points) == 12
    reply = spark.createDataFrame([(1, '```json {"strengths": ["a"], "threats": ["b", "c"]}```')], "company_id int, reply string")
    assert {(r.quadrant, r.point) for r in explain.swot_points(apps, reply).collect()} == {("strengths", "a"), ("threats", "b"), ("threats", "c")}
    junk = spark.createDataFrame([(1, "none")], "company_id int, reply string")
    assert explain.swot_points(apps, junk).count() == 12


def test_book_properties(spark, sf):
    book = reg.QUERIES["assess_borrowers"](spark, sf).cache()
    bad = book.where("NOT (rule_score BETWEEN 0 AND 100) OR NOT (score BETWEEN 25 AND 87.25) OR (blacklisted AND decision <> 'REJECT') "
                     "OR (decision = 'REJECT' AND (credit_limit <> 0 OR risk_premium IS NOT NULL)) OR (decision <> 'REJECT' AND risk_premium IS NULL)")
    assert bad.count() == 0
    assert book.count() == fx.applications(spark, sf).count()
    assert scoring.missing_required(fx.applications(spark, sf)).where("NOT complete").count() > 0


def test_unusable_values_do_not_end_the_job(spark):
    from creditloom.operators import gst, scoring

    returns = spark.createDataFrame([(1, "GSTR3B", "1,200.50", "x"), (1, "GSTR3B", "100.129", "5"), (2, "GSTR2A", None, None)],
                                    "company_id long, return_type string, taxable_value string, total_tax string")
    got = {r["company_id"]: (r["gst_revenue"], r["n_unusable_values"]) for r in gst.gst_revenue(returns).collect()}
    assert {k: (None if v[0] is None else float(v[0]), v[1]) for k, v in got.items()} == {1: (100.13, 1), 2: (None, 0)}
    assert gst.itc_reconcile(returns).count() == 2
    bank = spark.createDataFrame([(1, "Credit", "abc"), (1, "Credit", "7.5")], "company_id long, transaction_type string, amount string")
    assert [(float(r["bank_credits"]), r["n_unusable_values"]) for r in gst.bank_credits(bank).collect()] == [(7.5, 1)]
    apps = spark.createDataFrame([(1, 5e6, 1e6, "land", 11.0, 1e7)],
                                 "company_id long, loan_amount double, collateral_value double, collateral_type string, interest_rate double, turnover double")
    facts = spark.createDataFrame([(1, "pdf", 1, "net_worth", 1e22), (1, "pdf", 1, "current_ratio", 1e15), (1, "pdf", 1, "debt_to_equity", 2.5)],
                                  "company_id long, source_kind string, doc_order int, field string, value double")
    row = scoring.merge_facts(scoring.base_financials(apps), facts).collect()[0]
    assert (float(row["current_ratio"]), float(row["debt_to_equity"]), float(row["net_worth"]), row["n_unusable_facts"]) == (1.2, 2.5, 3e6, 2)


def test_short_replies_are_replaced_before_rating(spark):
    from creditloom.plans import assessment

    replies = spark.createDataFrame([(1, "short"), (2, None), (3, '{"overall_external_risk_rating": "Low", "risk_justification": "sound business"}')],
                                    "company_id long, reply string")
    got = {r["company_id"]: (r["risk_rating"], r["quota_warnings"]) for r in assessment.ratings(replies).collect()}
    failed = ("high \u2014 manual verification required", ["secondary_research"])
    assert got == {1: failed, 2: failed, 3: ("low", [])}


def test_large_numbers_are_written_out(spark):
    """From ten million on a double's own text has an exponent."""
    rows = [("99999999999.90", "99999999999.9"), ("10000000.00", "10000000.0"), ("0.00", "0.0"), ("-0.05", "-0.05"), ("41.30", "41.3"), ("100.00", "100.0"), (None, None)]
    df = spark.createDataFrame([(a, b) for a, b in rows], "a string, b string").select(F.col("a").cast("decimal(38,2)").alias("a"), "b")
    assert all(r["shown"] == r["b"] for r in df.select("b", explain.plain(F.col("a")).alias("shown")).collect())


def test_memos_are_read_by_their_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "APPROVE", "a"), (2, "REJECT", "b"), (3, "REJECT", "c")], "company_id int, decision string, value string")
    path = str(tmp_path / "memos")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        memo.read_memos(spark, path)
    memo.write_memos(rows.repartition(2), path)
    (tmp_path / "memos" / "decision=REJECT").joinpath("part-stray.parquet").write_bytes(next((tmp_path / "memos" / "decision=APPROVE").glob("part-*.parquet")).read_bytes())
    assert sorted((r.company_id, r.decision, r.value) for r in memo.read_memos(spark, path, schema=rows.schema).collect()) == sorted(map(tuple, rows.collect()))
    next((tmp_path / "memos" / "decision=APPROVE").glob("part-*.parquet")).unlink()
    with pytest.raises(ValueError, match="manifest"):
        memo.read_memos(spark, path, schema=rows.schema)
    empty = str(tmp_path / "none")
    memo.write_memos(rows.limit(0), empty)
    assert memo.read_memos(spark, empty, schema=rows.schema).count() == 0
