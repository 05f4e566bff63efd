"""License scan: an exact set-similarity join of text blocks with license statements.

A block is a run of as many words as a statement has. It matches when it holds at least ``THRESHOLD`` of the
statement's distinct words. Statement words are ordered by their frequency in the whole corpus, rarest first; a
matching block must hold one of the first ``n - need + 1`` of them (prefix filter), a text needs as many words as the
match (length filter), and when the first shared word stands at place i of the order, at most ``n - i`` can be shared
(positional condition, which these prefixes always meet). Occurrences of prefix words therefore are the only candidates; they join the statements by word,
and every window around an occurrence is checked exactly.

Beside the method, ``scan`` counts the base phrases: places where their words stand consecutively.

Defined results: a null or empty text has no words, no places (``first_word`` and ``last_word`` null), empty label
texts and score 0. Rows that repeat id and text get equal results each. Extra columns are ignored. Empty tables give
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import ascii_lower

THRESHOLD = 0.9
#: Everything that is neither a digit, a letter of either case nor outside ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Statements by which licenses are declared, as words.
STATEMENTS = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BREAKS), lambda w: w != "")


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _any(text: Column, needles: Sequence[str]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def word_ranks(rows: DataFrame, statements: Sequence[tuple[str, str]]) -> dict[str, int]:
    """Place of every statement word in the order of document frequency, over all rows. Bounded by the statements."""
    vocabulary = sorted({w for s, _ in statements for w in s.split()})
    counts = (
        rows.select(F.explode(F.array_intersect(words_of(F.lower("_text")), _texts(vocabulary))).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    n = {r["w"]: r["n"] for r in counts}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def matches(rows: DataFrame, statements: Sequence[tuple[str, str]] = STATEMENTS, threshold: float = THRESHOLD) -> DataFrame:
    """``_id, _hash, label, score`` for every text and label with a matching block; score is the best containment."""
    rank = word_ranks(rows, statements)
    prefix, table = [], []
    for k, (statement, label) in enumerate(statements):
        own = sorted(set(statement.split()), key=rank.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        first = own[: len(own) - need + 1]
        prefix += first
        table += [(w, k, i, label, own, len(statement.split()), need) for i, w in enumerate(first)]
    prefix = sorted(set(prefix))
    # One row per statement and prefix word: bounded by the statements, so this broadcast cannot grow with the data.
    entries = F.broadcast(rows.sparkSession.createDataFrame(
        table, "word string, k int, i int, label string, own array<string>, width int, need int"))
    widest = max(r[5] for r in table)
    least = min(r[6] for r in table)
    found = (
        rows.where(_any(F.lower("_text"), prefix))
        .select("_id", "_hash", words_of(ascii_lower(F.col("_text"))).alias("words"))
        .where(F.size("words") >= least)
        .select("_id", "_hash", "words", F.explode(F.filter(
            F.transform("words", lambda w, at: F.when(w.isin(prefix), F.struct(w.alias("word"), at.alias("at")))), lambda x: x.isNotNull())).alias("hit"))
        .select("_id", "_hash", F.col("hit.word").alias("word"),
                F.slice("words", F.greatest(F.col("hit.at") - widest + 2, F.lit(1)),
                        F.col("hit.at") + widest - F.greatest(F.col("hit.at") - widest + 1, F.lit(0))).alias("near"),
                F.least(F.col("hit.at"), F.lit(widest - 1)).alias("at"))
        .join(entries, "word")
        .where((F.size("own") - F.col("i") >= F.col("need")) & (F.size("near") >= F.col("need")))
    )
    first = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
    shared = F.array_max(F.transform(
        F.sequence(first, F.col("at")), lambda s: F.size(F.array_intersect(F.slice("near", s + 1, F.col("width")), "own"))))
    return (
        found.withColumn("shared", shared).where("shared >= need")
        .groupBy("_id", "_hash", "label").agg(F.max(F.col("shared") / F.size("own")).alias("score"))
    )


def _starts(phrase: str) -> Column:
    parts = phrase.split()

    def here(w: Column, i: Column) -> Column:
        hit = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get("_words", i + k) == part, F.lit(False))
        return F.when(hit, i)

    return F.filter(F.transform("_words", here), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", statements: Sequence[tuple[str, str]] = STATEMENTS,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per text: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    labelled = matches(rows, statements, threshold).groupBy("_id", "_hash").agg(
        F.collect_set("label").alias("_found"), F.max("score").alias("_score"))  # at most one entry per label
    lowered = F.when(_any(F.lower("_text"), sorted({p.split()[-1] for p, _ in PHRASES})), ascii_lower(F.col("_text")))
    places = F.when(F.col("_words").isNull(), F.array().cast("array<array<int>>")).otherwise(F.array(*[_starts(p) for p, _ in PHRASES]))
    base = (
        rows.select("_id", "_hash", F.size(words_of(F.col("_text"))).cast("long").alias("n_words"), words_of(lowered).alias("_words"))
        .select("_id", "_hash", "n_words", places.alias("_places"))
        .select(
            "_id", "_hash", "n_words", F.flatten("_places").alias("_all"),
            F.filter(F.array(*[F.when(F.size(F.get("_places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]),
                     lambda x: x.isNotNull()).alias("_base"))
    )
    same = (F.col("b._id").eqNullSafe(F.col("m._id"))) & (F.col("b._hash") == F.col("m._hash"))
    return base.alias("b").join(labelled.alias("m"), same, "left").select(
        F.col("b._id").alias(id_col), "n_words", F.size("_all").cast("long").alias("n_base"),
        F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
