"""Repeated runs of lines against a brute force that compares all lines with all earlier ones."""

import random

import pytest
from pyspark.sql import functions as F

from brute import plain_runs
from creditloom.llm import linededup
from creditloom.llm.queries import QUERIES


def runs(spark, rows):
    got = linededup.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    return {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in got.collect()}


def test_short_passages_in_unlike_texts(spark):
    """Passages of 2 to 6 lines lose all their lines whatever stands around them."""
    chance, rows, size = random.Random(3), [], {}
    for k in range(200):
        n = 2 + k % 5
        passage = [f"passage {k} line {i}" for i in range(n)]
        for copy in (0, 1):
            before, after = ([f"{k} {copy} {side} {i}" for i in range(chance.randint(0, 4))] for side in "ba")
            rows.append((2 * k + copy, "\n".join([*before, *passage, *after])))
        size[2 * k + 1] = n
    got = runs(spark, rows)
    assert got == plain_runs(rows)
    assert {i: n for i, (_, n) in got.items() if n} == size


def test_copies_blank_lines_and_overlaps(spark):
    copy = "\n\n".join(f"paragraph {i}\nwith line {i}" for i in range(30))
    rows = [(1, copy), (2, copy), (3, "x\n" + copy + "\ny"), (4, "a\na\na"), (5, "b\n" * 7), (6, "c\nd\n" * 5), (7, None), (8, ""), (9, "e\n \ne\n \ne"),
            (10, "d\n\nc"), (11, "d\nc"), (12, "a\na")]
    got = runs(spark, rows)
    assert got == plain_runs(rows)
    assert got[2][0] == "" and got[3][0] == "x\ny" and got[4][0] == "a\na\na"


def test_random_lines(spark):
    chance = random.Random(4)
    rows = [(i, "\n".join(chance.choice(["a", "b", "c", "d", "e", "", " "]) for _ in range(chance.randint(0, 14)))) for i in range(150)]
    assert runs(spark, rows) == plain_runs(rows)


def test_query(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = plain_runs(docs)
    got = {r["doc_id"]: r["n_lines_removed"] for r in QUERIES["op6_line_dedup"](spark, sf).collect()}
    assert got == {i: n for i, (_, n) in want.items()} and sum(got.values()) > 0


def test_most_lines_of_copies_go_as_chunks():
    """Equal passages are cut alike inside, whatever stands around them, and no chunk has less than two lines."""
    chance = random.Random(5)
    passage = [f"line {i}" for i in range(400)]
    cut = []
    for side in ("b", "a"):
        lines = [*[f"{side} {i}" for i in range(chance.randint(3, 9))], *passage, *[f"{side} end {i}" for i in range(chance.randint(3, 9))]]
        spans = linededup.chunks(lines, list(range(len(lines))))
        assert [a for a, _ in spans][1:] == [b for _, b in spans][:-1] and min(b - a for a, b in spans) >= 2
        cut.append({tuple(lines[a:b]) for a, b in spans})
    assert sum(map(len, cut[0] & cut[1])) > 380


def test_bytes_are_compared(spark):
    """Units with one hash go only where their bytes equal those of the first."""
    rows = [(1, 1, 0, 2, b"same", b"a"), (2, 2, 0, 2, b"same", b"b"), (3, 3, 4, 6, b"same", b"a"), (4, 4, 0, 2, b"alone", b"a")]
    df = spark.createDataFrame(rows, linededup.UNIT_SCHEMA)
    assert [tuple(r) for r in linededup.repeated_units(lambda bits: df, "test").collect()] == [(3, 3, 4, 6)]


def test_empty_repeated_and_clashing(spark):
    assert linededup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "x\na\nb"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(5).alias("_slot"), F.lit(6).alias("n_lines"), F.lit(7).alias("slot"), F.lit(8).alias("bits"))
    got = linededup.dedup(docs)
    assert got.columns == ["doc_id", "text", "_slot", "slot", "bits", "n_lines", "n_lines_removed"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([
        (1, "a\nb\nc", 5, 7, 8, 3, 0), (1, "a\nb\nc", 5, 7, 8, 3, 0), (None, "a\nb\nc", 5, 7, 8, 3, 0), (2, "x", 5, 7, 8, 3, 2), (3, None, 5, 7, 8, 0, 0)], key=repr)
    with pytest.raises(ValueError):
        linededup.dedup(docs.withColumn("_l_drop", F.lit(1)))
