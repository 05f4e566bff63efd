"""Sources, tax-return and bank operators, screening, and the skew helpers."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv
from creditloom.operators import gst, research, screening
from creditloom.skew import number_rows, salted_join
from creditloom.sources import defaulters, files, tables


def test_read_table(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("company_id,amount\n1,2.5\n2,\n")
    df = tables.read_table(spark, str(p))
    assert dict(df.dtypes) == {"company_id": "int", "amount": "double"} and df.count() == 2
    assert dict(tables.read_table(spark, str(p), "company_id bigint, amount decimal(10,2)").dtypes)["amount"] == "decimal(10,2)"
    with pytest.raises(AnalysisException):
        tables.read_table(spark, str(tmp_path / "absent.csv"))
    assert tables.to_records(df).collect()[1].record == '{"company_id":2,"amount":null}'


def test_defaulter_lists(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("party,bknm,osamt,suit\nAcme Ltd,PNB,10,SUIT\nToo Long,PNB,1,SUIT,extra\nShort,PNB\n")
    b.write_text("PRTY,BKNM,OSAMT (Rs. Lac),SUIT\nBeta,IDBI,20,\n")
    got = [tuple(r) for r in defaulters.load_defaulters(spark, [str(a), str(tmp_path / "no.csv"), str(b)]).orderBy("name").collect()]
    assert got == [("Acme Ltd", "PNB", "10", "SUIT"), ("Beta", "IDBI", "20", None), ("Short", "PNB", None, None)]
    assert defaulters.load_defaulters(spark, [str(tmp_path / "no.csv")]) is None


def test_defaulter_lists_are_never_silently_clear(spark, tmp_path):
    """Headers in any case count; lists without a header, unreadable ones and absent ones are told apart; left-out lines are listed."""
    a, bare, empty = (tmp_path / n for n in ("a.csv", "bare.csv", "empty.csv"))
    a.write_text("Party, BkNm ,OsAmt,Suit\nAcme Ltd,PNB,10,SUIT\nToo Long,PNB,1,SUIT,extra\n")
    assert [tuple(r) for r in defaulters.load_defaulters(spark, [str(a)]).collect()] == [("Acme Ltd", "PNB", "10", "SUIT")]
    assert [tuple(r) for r in defaulters.rejected_lines(spark, [str(a), str(tmp_path / "no.csv")]).collect()] == [(str(a), "Too Long,PNB,1,SUIT,extra")]
    assert defaulters.rejected_lines(spark, [str(tmp_path / "no.csv")]) is None
    bare.write_text("Acme Ltd,PNB,10,SUIT\n")
    empty.write_text("")
    for path in (bare, empty):
        with pytest.raises(ValueError, match="no column of names"):
            defaulters.load_defaulters(spark, [str(a), str(path)])
    with pytest.raises(Exception, match="(?i)nosuchscheme|scheme"):
        defaulters.load_defaulters(spark, ["nosuchscheme://store/list.csv"])


def test_warehouse_fallback(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id\n" + "\n".join(str(i) for i in range(30)))
    assert tables.load_or_fallback(spark, "no_such_table", str(p), ["id"]).count() == 30
    spark.range(30).createOrReplaceTempView("stored_credit")
    assert [r.id for r in tables.load_or_fallback(spark, "stored_credit", str(p), ["id"], 5).collect()] == [0, 1, 2, 3, 4]
    assert tables.load_jdbc_or_fallback(spark, {}, str(p), ["id"]).count() == 30


def test_validation(spark, tmp_path):
    g, b = tmp_path / "g.csv", tmp_path / "b.csv"
    g.write_text("taxable_value\n1\n")
    b.write_text("amount,kind\n1,x\n")
    out = tables.load_and_validate(spark, str(g), str(b))
    assert out["gst_valid"] and not out["bank_valid"] and out["gst_df"].count() == 1


def test_routes(spark):
    names = [("a.PDF",), ("b.xlsx",), ("c.csv",), ("d.jpeg",), ("e.txt",), ("noext",), ("f.tar.xls",)]
    got = {r.path: (r.extractor, r.error) for r in files.route_files(spark.createDataFrame(names, "path string")).collect()}
    assert got == {"a.PDF": ("pdf", None), "b.xlsx": ("workbook", None), "c.csv": ("csv", None), "d.jpeg": ("image", None),
                   "e.txt": ("none", "Unsupported: txt"), "noext": ("none", "Unsupported: noext"), "f.tar.xls": ("workbook", None)}


def test_cross_verify_levels_and_missing_sides(spark):
    returns = spark.createDataFrame([(1, 100), (2, 130), (3, 150), (4, 50)], "company_id int, taxable_value int")
    bank = spark.createDataFrame([(1, "Credit", 100), (2, "neft credit", 100), (3, "CREDIT", 100), (5, "credit", 10), (1, "debit", 999), (1, None, 999)],
                                 "company_id int, transaction_type string, amount int")
    got = {r.company_id: r for r in gst.cross_verify(returns, bank).collect()}
    assert {k: (r.discrepancy_pct, r.risk_level, len(r.flags)) for k, r in got.items()} == {
        1: (0.0, "low", 0), 2: (30.0, "medium", 1), 3: (50.0, "high", 2), 4: (0.0, "low", 0), 5: (100.0, "high", 2)}
    assert got[2].flags == ["Revenue mismatch of 30.0% between GST and bank statement"]
    assert got[4].no_bank_data and not got[1].no_bank_data


def test_columns_are_found_by_name_parts(spark):
    odd = spark.createDataFrame([(1, "x", 7.0, 5.0)], "company_id int, a string, b double, c double")
    assert gst.gst_revenue(odd).first().gst_revenue == Decimal("5.00")  # no name fits: the third column
    assert gst.bank_credits(odd).first().bank_credits == 0


def test_itc_messages(spark):
    rows = [(1, "GSTR3B", 150.0), (1, "GSTR2A", 100.0), (2, "GSTR3B", 80.0), (2, "GSTR2A", 100.0), (3, "GSTR3B", 5.0), (4, "GSTR2A", 100.0), (4, "GSTR3B", 70.0)]
    got = {r.company_id: r for r in gst.itc_reconcile(spark.createDataFrame(rows, "company_id int, return_type string, total_tax double")).collect()}
    assert (got[1].risk_level, got[1].itc_variance_pct, len(got[1].flags)) == ("high", 50.0, 2)
    assert (got[2].risk_level, got[2].signed_variance, got[2].flags) == ("low", -20.0, [])
    assert got[3].flags == [fv.FLAG_NO_2A] and got[3].itc_claimed == 0.0
    assert got[4].risk_level == "medium" and got[4].itc_variance == 30.0
    bare = gst.itc_reconcile(spark.createDataFrame([(1, 2.0)], "company_id int, total_tax double")).first()
    assert bare.flags == [fv.FLAG_NO_RETURN_TYPE] and bare.risk_level == "low"


@pytest.mark.parametrize("accuracy", [20_000, 8])
def test_describe_is_exact_on_skewed_values(spark, accuracy):
    rng = random.Random(3)
    values = [5.0] * 700 + [round(rng.expovariate(0.01), 2) for _ in range(1301)] + [1e6, None, -3.25]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a double, b int")
    got = {r.column: r for r in gst.describe_numeric(df, ["a", "b"], accuracy).collect()}
    known = np.array([v for v in values if v is not None])
    for column, x in (("a", known), ("b", np.arange(len(values)))):
        r = got[column]
        assert r["count"] == len(x) and r.min == x.min() and r.max == x.max()
        assert [r.q25, r.q50, r.q75] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])), abs=1e-6)
        assert r.mean == pytest.approx(x.mean()) and r.std == pytest.approx(x.std(ddof=1))


def test_describe_selects_exactly_in_wide_and_hot_columns(spark):
    """A third of the rows share one value, and values span 18 digits; equal to sorting at every bucket count."""
    rng = random.Random(11)
    wide = [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 14) for _ in range(600)] + [42.5] * 300
    df = spark.createDataFrame([(f"{v:.4f}",) for v in wide], "wide string").repartition(5)
    known = np.array(sorted(float(f"{v:.4f}") for v in wide))
    for buckets in (2, 7, 1024):
        r = gst.describe_numeric(df, ["wide"], buckets).first()
        assert [r.q25, r.q50, r.q75] == pytest.approx(list(np.quantile(known, [0.25, 0.5, 0.75])), rel=1e-12)
        assert (r["count"], r.min, r.max) == (900, known[0], known[-1])


def test_describe_of_nulls_single_values_and_no_rows(spark):
    df = spark.createDataFrame([(None, 3.5, 1), (None, None, 1)], "none double, one double, `a b` int")
    got = {r.column: r for r in gst.describe_numeric(df, ["none", "one", "a b"]).collect()}
    assert sorted(got) == ["a b", "one"]
    assert (got["one"].min, got["one"].q25, got["one"].q50, got["one"].max, got["one"].std) == (3.5, 3.5, 3.5, 3.5, None)
    assert (got["a b"]["count"], got["a b"].q75, got["a b"].std) == (2, 1.0, 0.0)
    assert gst.describe_numeric(df.limit(0), ["one"]).count() == 0
    with pytest.raises(ValueError):
        gst.describe_numeric(df, ["one"], 1)


def test_selected_ranks_equal_sorting(spark):
    rng = random.Random(5)
    values = sorted(rng.choice([7, rng.randint(-50, 50), rng.randint(-10**9, 10**9)]) for _ in range(400))
    df = spark.createDataFrame([(v,) for v in values], "v long").selectExpr("cast(v as decimal(33,0)) AS u0")
    ranks = set(range(0, 400, 7)) | {399}
    got = gst.values_at_ranks(df, {0: (values[0], values[-1])}, {0: ranks}, 16)
    assert got == {(0, r): values[r] for r in ranks}


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    names = [word(rng.randint(1, 30)) for _ in range(150)]
    terms = [word(rng.randint(1, 14)) for _ in range(150)] + [n[2:17] for n in names if len(n) > 17] + ["a.*", "zz"]
    terms = [t for t in terms if t]
    pairs = screening.substring_pairs(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string"))
    got = sorted((r.term, r.name) for r in pairs.collect())
    assert got == sorted((t, n) for t in set(terms) for n in set(names) if t in n)


def test_shards_and_slices_change_no_pair(spark, monkeypatch):
    """Terms of one and two characters, terms inside terms, and many shards and slices."""
    chance = random.Random(4)
    terms = ["a", "ab", "b", "bab", "é", "日", "", "aab", *{"".join(chance.choice("abcé") for _ in range(chance.randint(1, 6))) for _ in range(150)}]
    names = ["".join(chance.choice("abcé 日") for _ in range(chance.randint(0, 25))) for _ in range(200)] + [None]
    want = sorted({(t, n) for t in terms for n in names if t and n and t in n})
    frames = spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string")
    for shard, piece in ((1_000_000, 1_000_000), (60, 700)):
        monkeypatch.setattr(screening, "SHARD_CHARS", shard)
        monkeypatch.setattr(screening, "SLICE_CHARS", piece)
        assert sorted(map(tuple, screening.substring_pairs(*frames).collect())) == want
    assert screening.substring_pairs(frames[0].limit(0), frames[1]).count() == 0 == screening.substring_pairs(frames[0], frames[1].limit(0)).count()


def test_blacklist_keeps_duplicates_and_terms(spark):
    apps = spark.createDataFrame([(1, "Acme", "Raj, , Acme"), (2, None, None), (3, "Other", "")], "company_id int, company_name string, promoter_names string")
    listed = spark.createDataFrame([("M/S ACME AND RAJ", "PNB", "1", None), ("M/S ACME AND RAJ", "IDBI", "2", None), (None, "X", "3", None)],
                                   "name string, bank string, outstanding_amount string, suit_filed string")
    matches = screening.blacklist_matches(apps, listed)
    got = sorted((r.company_id, r.matched_term, r.bank) for r in matches.collect())
    assert got == sorted([(1, t, b) for t in ("acme", "raj", "acme") for b in ("PNB", "IDBI")])
    summary = {r.company_id: (r.blacklisted, r.n_matches, r.risk) for r in screening.blacklist_summary(matches, apps).collect()}
    assert summary == {1: (True, 6, "critical"), 2: (False, 0, "clear"), 3: (False, 0, "clear")}
    assert {r.risk for r in screening.blacklist_summary(None, apps).collect()} == {"unknown"}


def test_history(spark):
    apps = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "company_id int, company_name string")
    history = spark.createDataFrame([("A", 10), ("A", 11), ("C", 12)], "company_name string, loan int")
    got = sorted((r.company_id, r.found, r.loan or 0, r.message) for r in screening.with_history(apps, history).collect())
    assert got == [(1, True, 10, None), (1, True, 11, None), (2, False, 0, fv.NO_HISTORY), (3, False, 0, fv.NO_HISTORY)]


def test_number_rows_with_a_hot_key(spark):
    df = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 50 END AS k", "(id * 7919) % 4001 AS o")
    got = number_rows(df, ["k"], ["o"], {"_b": F.expr("o div 100")}, "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o")))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_number_rows_of_large_keys_and_nulls(spark):
    """Keys above and below the limit are numbered alike; rows with a null key or block are counted but left out."""
    df = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 97 = 0 THEN NULL ELSE id % 50 END AS k", "IF(id % 41 = 0, NULL, (id * 7919) % 4001) AS o", "id")
    got = number_rows(df, ["k"], ["o", "id"], {"_b": F.expr("o div 100")}, "rn", large=100)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "id"))).where("k is not null and o is not null")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_number_rows_shuffles_small_keys_once(spark, tmp_path):
    """Where no key is large, rows are shuffled once, with no join of every block's size."""
    spark.range(40_000).selectExpr("id % 9000 AS k", "id AS o").write.parquet(str(tmp_path / "rows"))
    got = number_rows(spark.read.parquet(str(tmp_path / "rows")), ["k"], ["o"], {"_b": F.col("o")}, "rn")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin") == 0 and plan.count("Sort [k") == 1, plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 20 END AS k")
    right = spark.range(0, 15).selectExpr("id AS k", "id * 2 AS v")
    got = salted_join(left, right, ["k"], F.col("id"), how=how).select("id", "k", "v")
    want = left.join(right, "k", how).select("id", "k", "v")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_reply_cache(spark):
    prompts = spark.createDataFrame([(i, "hot" if i % 3 else f"p{i % 7}") for i in range(100)], "prompt_id int, prompt string")
    cache = prompts.where("prompt = 'hot'").select(research.prompt_key(F.col("prompt")).alias("key")).distinct().withColumn("reply", F.lit("r"))
    hits, todo = research.split_cached(prompts, cache)
    assert hits.count() == prompts.where("prompt = 'hot'").count()
    assert sorted(r.prompt for r in todo.collect()) == [f"p{i}" for i in range(7)]


def test_research_context(spark):
    asked = [("research", q) for q in range(6)] + [("legal", q) for q in range(3)]
    hits = spark.createDataFrame([(1, kind, q, r, f"{kind[0] if kind == 'legal' else 'u'}{q}{r}", "c" * 600) for kind, q in asked for r in range(3)],
                                 "company_id int, kind string, query_no int, hit_rank int, url string, content string")
    row = research.build_context(hits, **research.RESEARCH_SHAPE).first()
    assert row.sources == [f"u{q}{r}" for q in range(6) for r in range(2)]
    whole = "\n\n".join(f"Source {i + 1}: {u}\n" + "c" * 500 for i, u in enumerate(row.sources))
    assert row.context == whole[:6000]
    legal = research.build_context(hits, **research.LEGAL_SHAPE).first()
    assert legal.sources == [f"l{q}{r}" for q in range(3) for r in range(2)] and legal.context.count("c" * 400) == 6
    assert research.build_context(hits).first().context.count("c" * 600) == 12


def test_note_parts_and_adjustment(spark):
    notes = spark.createDataFrame([(1, i, f"n{i}") for i in range(600)], "company_id int, note_no int, note string")
    parts = research.bullet_parts(notes, "note_no").orderBy("part_no").collect()
    assert "\n".join(p.notes for p in parts) == "\n".join(f"- n{i}" for i in range(600)) and len(parts) == 3
    scores = spark.createDataFrame([(i, 90.0) for i in range(1, 6)], "company_id int, score double")
    replies = spark.createDataFrame([(1, '```json {"score_adjustment": 20}```'), (2, "nope"), (3, '{"score_adjustment": -200}'), (4, "{}")], "company_id int, reply string")
    got = {r.company_id: (r.adjusted_score, r.raw_response) for r in research.qualitative_adjust(scores, replies).collect()}
    assert got == {1: (100.0, None), 2: (90.0, "nope"), 3: (0.0, None), 4: (90.0, None), 5: (90.0, None)}


def test_hit_counts_equal_counted_matches(spark):
    apps = spark.createDataFrame([(1, "Acme", "Bob, Al"), (2, "Zed", ""), (3, "acme", None)], "company_id int, company_name string, promoter_names string")
    lists = spark.createDataFrame([("Acme Ltd", "b"), ("ACME ltd", "c"), ("Bobby", "d"), (None, "e"), ("x", "f")], "name string, bank string").selectExpr(
        "name", "bank", "'1' AS outstanding_amount", "'y' AS suit_filed")
    want = sorted(map(tuple, screening.match_counts(screening.blacklist_matches(apps, lists)).select("company_id", "n_matches", "blacklisted").collect()))
    assert want and sorted(map(tuple, screening.hit_counts(apps, lists).select("company_id", "n_matches", "blacklisted").collect())) == want
