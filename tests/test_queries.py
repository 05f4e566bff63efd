"""Every checked query against its DuckDB statement, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from creditloom.plans import registry
from creditloom.plans.oracle import ORACLE
from creditloom.plans.registry import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture(scope="module", autouse=True)
def few_rounds():
    """Three boosting rounds are enough for what these tests ask of a model."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registry, "MODEL_ROUNDS", 3)
        yield


def rows_of(rows, order):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(key, spark, sf, duck):
    rel = duck.execute(ORACLE[key])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    df = QUERIES[key](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert set(dict(df.dtypes).values()) <= set(TYPES)
    got = df.collect()
    assert rows_of(got, [df.columns.index(c) for c in sorted(names)]) == rows_of(want, [names.index(c) for c in sorted(names)])
    assert got


def test_entry_module(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())
    unchecked = set(QUERIES) - set(ORACLE)
    assert unchecked == {"train_default_model", "model_store", "score_loans", "attributions", "assess_with_model", "applicant_factors"}
    flagship = entry_module.entry(spark)
    assert flagship.count() == 150
    decisions = {r.decision for r in flagship.select("decision").distinct().collect()}
    assert decisions <= {"APPROVE", "CONDITIONAL APPROVE", "REJECT"}


def test_model_queries(spark, sf):
    counts = {k: QUERIES[k](spark, sf).count() for k in ("score_loans", "train_default_model", "attributions", "assess_with_model")}
    assert counts == {"score_loans": 1500, "train_default_model": 5, "attributions": 18000, "assess_with_model": 150}
    assert QUERIES["model_store"](spark, sf).count() >= 2 and QUERIES["applicant_factors"](spark, sf).count() >= 450
