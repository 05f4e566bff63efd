"""Near-duplicate groups of the LSH forest against all pairs."""

import random

from pyspark.sql import functions as F

import brute
from creditloom.llm import forest


def found(spark, rows):
    got = forest.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def test_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute.groups(docs, 2, 80)
    assert found(spark, docs) == want
    assert any(i != c for i, (_, c) in want.items())


def test_chains_and_border_cases(spark):
    """Texts that differ by the words that make the similarity just 0.80 or just less, and chains of changes."""
    chance = random.Random(6)
    word = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = [chance.choice(word) for _ in range(chance.randint(1, 120))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(chance.randint(0, 6)):
            base = list(base)
            for _ in range(chance.randint(0, max(1, len(base) // 16))):
                base[chance.randrange(len(base))] = chance.choice(word)
            rows.append((len(rows), " ".join(base).upper() if k % 3 else "\n".join(base)))
    five, four = "a b c d e f", "a b c d e"  # 4 of 5 shingles are shared
    rows += [(len(rows), five), (len(rows) + 1, four), (len(rows) + 2, "a b c d")]
    assert found(spark, rows) == brute.groups(rows, 2, 80)


def test_large_group_without_its_pairs(spark):
    """Many copies of one text, each with changes of its own, beside unlike texts that share a frequent passage: larger than a region."""
    chance = random.Random(7)
    word = [f"w{i}" for i in range(5000)]
    base = [chance.choice(word) for _ in range(150)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(6):
            copy[chance.randrange(len(copy))] = chance.choice(word)
        rows.append((i, " ".join(copy)))
    passage = [chance.choice(word) for _ in range(60)]
    rows += [(400 + i, " ".join([*passage, *[chance.choice(word) for _ in range(25)]])) for i in range(300)]
    assert found(spark, rows) == brute.groups(rows, 2, 80)


def test_regions_fall_apart(spark, monkeypatch):
    """Copies that are linked come together although their regions are too large to be searched."""
    monkeypatch.setattr(forest, "REGION", 8)
    chance = random.Random(9)
    word = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(3):
        base = [chance.choice(word) for _ in range(200)]
        for _ in range(150):
            copy = list(base)
            for _ in range(chance.randint(0, 5)):
                copy[chance.randrange(len(copy))] = chance.choice(word)
            rows.append((len(rows), " ".join(copy)))
    assert found(spark, rows) == brute.groups(rows, 2, 80)


def test_links_in_large_regions_are_all_found(spark, monkeypatch):
    """Texts that are alike but linked in pairs only, in regions too large to be searched that agree in all values of a key."""
    monkeypatch.setattr(forest, "REGION", 1)
    monkeypatch.setattr(forest, "KEY", forest.FIRST)
    chance = random.Random(13)
    rows = []
    for i in range(150):
        copy = [f"w{k}" for k in range(60)]
        for at in chance.sample(range(60), 2):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
    want = brute.groups(rows, 2, 80)
    assert any(i != c for i, (_, c) in want.items())
    assert found(spark, rows) == want


def test_copies_of_one_text_are_not_paired(spark, monkeypatch):
    """Copies too unlike for links among themselves come together by the text they stem from, not by comparing them in pairs."""
    tried = []
    confirmed = forest._confirmed

    def counted(pairs, nodes, texts, name):
        pairs = pairs.cache()
        tried.append(pairs.count())
        return confirmed(pairs, nodes, texts, name)

    monkeypatch.setattr(forest, "_confirmed", counted)
    chance = random.Random(14)
    base = [f"w{i}" for i in range(60)]
    rows = [(1000, " ".join(base))]
    for i in range(400):
        copy = list(base)
        for at in chance.sample(range(60), 3):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows) == brute.groups(rows, 2, 80)
    assert sum(tried) < 5 * len(rows)


def test_alike_texts_leave_no_pairs(spark, monkeypatch):
    """Texts that are alike but hardly ever linked: no step hands on more rows than there are nodes in trees."""
    made = {}
    stored = forest.stored

    def counted(rows, name):
        out = stored(rows, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(forest, "stored", counted)
    chance = random.Random(15)
    rows = []
    for i in range(300):
        copy = [f"w{k}" for k in range(100)]
        for at in chance.sample(range(100), 5):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
        if i % 50 == 0:
            rows.append((1000 + i, " ".join([*copy[:-4], "y", *copy[-4:]])))
    want = brute.groups(rows, 2, 80)
    assert sum(i != c for i, (_, c) in want.items()) >= 6
    assert found(spark, rows) == want
    assert max(made.values()) <= forest.TREES * len(rows)
    assert made["forest-regions"] < len(rows)


def test_large_regions_hand_on_only_rarest_shingles(spark, monkeypatch):
    made = {}
    stored = forest.stored

    def counted(rows, name):
        out = stored(rows, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(forest, "stored", counted)
    monkeypatch.setattr(forest, "REGION", 2)
    chance = random.Random(16)
    rows = []
    for i in range(100):
        copy = [f"w{k}" for k in range(200)]
        for at in chance.sample(range(200), 9):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows) == brute.groups(rows, 2, 80)
    assert max(n for name, n in made.items() if name in ("forest-shingles", "forest-rarest")) <= 40 * len(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (2, "ONE two\tthree  four"), (3, None), (4, ""), (5, " \n"), (6, "word"), (7, "WORD"),
            (None, "one two three four"), (8, "é ÉÉ"), (9, "É ÉÉ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(9).alias(c) for c in ("id", "n", "h", "u", "v", "key", "_slot")])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in forest.groups(docs).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False),
                          (None, 3, None, True), (8, 1, 8, True), (9, 1, 9, True)], key=repr)
    assert forest.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    chance = random.Random(8)
    long = [f"w{chance.randrange(40_000)}" for _ in range(200_000)]
    near = list(long)
    for _ in range(9000):
        near[chance.randrange(len(near))] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:1000]))]
    assert found(spark, rows) == brute.groups(rows, 2, 80)
