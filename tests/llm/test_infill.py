"""Fill-in-the-middle against a plain version that cuts lists of tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from creditloom.llm import infill

TEXTS = ["", "a", "abc def", "Grüße aus Köln\nß", "日本語 text 漢字 mixed", "😀a😀😀b cd", "x<P>y", "ends in <S>", "<M>", "almost <P <S <M >P>", "a" * 300_000 + "é" * 1000,
         "\x00 nul \t tab", "İstanbul ﬁ", "<", "<<S", "é", "  \n \n"]


def rows_of(docs, **how):
    rows = infill.transform(docs, **how).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    return [(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in rows]


def test_against_plain_version(spark):
    chance = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(1000 + i, "".join(chance.choice("ab <>PSM\né日😀") for _ in range(chance.randint(0, 80)))) for i in range(300)]
    forms = set()
    for i, text, *found, again in rows_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)):
        assert tuple(found) == brute.infill(i, text)
        assert again == text
        forms.add(found[1])
    assert forms == {"plain", "psm", "spm"}


def test_units_of_code_points(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)]
    for i, text, n, form, prefix, middle, output, again in rows_of(spark.createDataFrame(rows, "doc_id long, text string"), unit="char"):
        assert n == len(text) and again == text
        if form != "plain":
            h1, h2, _, _ = infill.draws(1, str(i))
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            assert (prefix, middle) == (a, b - a)
            assert output == (f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}" if form == "psm" else f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}")
    with pytest.raises(ValueError):
        infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit="word")


@pytest.mark.parametrize("text", [t for t in TEXTS if len(t) < 1000])
def test_index_converts_both_ways(text):
    raw = text.encode()
    index = infill.ExceptionIndex(np.frombuffer(raw, np.uint8))
    assert len(index.bytes) == sum(1 for c in text if ord(c) > 127)
    for chars in range(len(text) + 1):
        cut = len(text[:chars].encode())
        assert (index.to_chars(cut), index.to_bytes(chars)) == (chars, cut)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "one two three", 7, "old"), (1, "one two three", 7, "old"), (None, "no id here", None, None), (2, None, 1, "x")]
    got = infill.transform(spark.createDataFrame(rows, "doc_id long, text string, n int, output string").withColumn("_slot", F.lit(1)))
    assert got.columns == ["doc_id", "text", "_slot", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = [tuple(r) for r in got.collect()]
    assert found[0] == found[1] and found[0][3:] == brute.infill(1, "one two three")
    assert found[2][3:] == brute.infill(None, "no id here")
    assert found[3] == (2, None, 1, 0, "plain", None, None, "")
    assert infill.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert infill.transform(spark.createDataFrame([("k", "text ids work")], "doc_id string, text string")).collect()[0]["n"] == 5


def test_restored_digest_of_the_query(spark, sf):
    from creditloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op12_infill"](spark, sf).collect():
        n, form, prefix, middle, output = brute.infill(r["doc_id"], texts[r["doc_id"]])
        sha = brute.hashlib.sha256
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == sha(output.encode()).hexdigest() and r["restored_sha256"] == sha((texts[r["doc_id"]] or "").encode()).hexdigest()
