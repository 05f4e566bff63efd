"""The registered corpus queries against their DuckDB statements, and the pipeline against plain versions."""

import duckdb
import pytest

import brute
import corpus_pipeline
from creditloom.llm import linededup, quality
from creditloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(key, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.execute(ORACLE[key])
    names = [d[0] for d in rel.description]
    got = QUERIES[key](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = rows_of(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, sf)
        if k == 4:
            pieces = result.collect()
            assert {p["doc_id"] for p in pieces} == {i for i, _ in before}
            assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
            break
        assert result.columns == columns
        result.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        after = rows_of(docs)
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if k == 0:
            failed = {i for i, t in before if brute.quality(t)[5]}
            assert {i for i, _ in after} <= {i for i, _ in before} - failed
            assert after == sorted((i, t) for i, t in before if i in {j for j, _ in after})
            assert {i for i, _ in after} == {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
        if k == 1:
            assert [i for i, _ in after] == [i for i, _ in before] and after != before
            for (_, new), (_, old) in zip(after, before, strict=True):
                assert set(new.split("\n")) <= {*old.split("\n"), ""}
        if k == 2:
            groups = brute.groups(before)
            assert after == [(i, t) for i, t in before if groups[i][1] == i]
        if k == 3:
            want = brute.repeats(before)
            assert [(i, len(t.encode())) for i, t in after] == [(i, want[i][0] - want[i][1]) for i, _ in before if True] or all(
                abs(len(t.encode()) - (want[i][0] - want[i][1])) <= 3 * max(1, want[i][2]) for i, t in after)
        before = after
    assert linededup.MIN_LINES == 2
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)
