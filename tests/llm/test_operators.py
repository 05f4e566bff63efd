"""The corpus operators against plain versions, on awkward rows and on the smallest tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from creditloom.llm import bpe, jaccard, licenses, linededup, lm, ordermin, packing, quality, repeats, warc
from creditloom.llm.queries import QUERIES

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARAGRAPH = " ".join(f"word{i * i % 57} and" for i in range(40))
LICENSE = "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License"
AWKWARD = [
    (1, None), (2, ""), (3, "a"), (4, " \n\t \n"), (5, PARAGRAPH), (6, PARAGRAPH), (7, PARAGRAPH + " tail <|endoftext|> x"),
    (8, LICENSE), (9, "b " * 3000 + LICENSE + "\nlicensed under cc by-nc 4.0!"), (10, "x" * 60_000), (11, "ÄÉ ß 中文 😀 İÍ ½    end  "),
    (12, "one line here\nsecond line there\n" * 30), (13, "one line here\nsecond line there\nthird"), (15, "| a | # * $ %" * 9), (20, "The End. " * 4),
]
CLASHING = ["ids", "n_tokens", "kept", "n_words", "score", "block", "id", "h", "label", "n_lines", "component", "payload", "start", "held_out", "edited", "n_bytes"]


@pytest.fixture(scope="module")
def docs(spark):
    """The awkward rows, dealt over partitions, with extra columns that bear names the operators use."""
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(4)
    return rows.withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def listed(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda x: x[0])


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def test_codec_equals_the_library():
    word, byte = bpe.codec(WORD_BPE), packing.piece_tokenizer(BYTE_BPE)
    libraries = Tokenizer.from_file(WORD_BPE), Tokenizer.from_file(BYTE_BPE)
    chance = random.Random(5)
    parts = ["a", "b", "The", " ", "  ", "\n", "\t", " \n", "'s", "'S", "é", "Σ", "ΑΣ", "1", "23", "<|endoftext|>", "<|startoftext|>", ".", "...", "́",
             " ", " ", "中文", "😀", "İ", "\x1c", "\x85", "ß", "\r\n", "Ⅷ", "²", "\x00"]
    for _ in range(1500):
        text = "".join(chance.choice(parts) for _ in range(chance.randint(0, 12)))
        for own, library in zip((word, byte), libraries, strict=True):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        ids = libraries[0].encode(text, add_special_tokens=False).ids
        assert word.decode(word.encode(text)) == libraries[0].decode(ids, skip_special_tokens=False)


def test_segment_tree_gives_leftmost_lowest():
    chance = random.Random(1)
    for n in (1, 2, 3, 7, 8, 9):
        ranks = [chance.choice([1, 2, 5, bpe.NO_RANK]) for _ in range(n)]
        tree = bpe.PairTree(list(ranks))
        for _ in range(20):
            least = min(ranks)
            assert tree.leftmost_lowest() == (-1 if least == bpe.NO_RANK else ranks.index(least))
            at, ranks_at = chance.randrange(n), chance.choice([0, 1, 3, bpe.NO_RANK])
            ranks[at] = ranks_at
            tree.put(at, ranks_at)


def test_piece_cache_evicts(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 4)
    own, library = bpe.Codec(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    text = " ".join(f"piece{i % 9}" for i in range(50))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.cache) <= 4


def test_op1_awkward(docs):
    got = by_id(bpe.encode_decode(docs, WORD_BPE), "ids", "n_tokens", "decoded", "kept")
    for i, text in AWKWARD:
        ids, decoded = brute.encoded(WORD_BPE, text)
        assert (np.frombuffer(got[i][0], "<u4").tolist(), *got[i][1:]) == (ids, len(ids), decoded, "mine")


def test_op1_query(spark, sf, given):
    got = by_id(QUERIES["op1_bpe"](spark, sf), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text in listed(given)[:60]:
        ids, decoded = brute.encoded(WORD_BPE, text)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert len(got) == given.count()


@pytest.mark.parametrize("block_bytes", [400, 1 << 20])
def test_op2_scores(docs, monkeypatch, block_bytes):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block_bytes)
    got = by_id(lm.score_texts(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for (i, _), want in zip(AWKWARD, brute.lm_scores(AWKWARD, lm.MASS), strict=True):
        assert got[i][:4] == want[:4]
        assert got[i][4:] == pytest.approx(want[4:], abs=1e-6)


def test_op2_query_beats_its_base(spark, sf, given):
    rows = listed(given)
    got = by_id(QUERIES["op2_lm"](spark, sf), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for (i, _), want in zip(rows, brute.lm_scores(rows, lm.MASS), strict=True):
        assert got[i][:4] == want[:4]
        assert got[i][4:] == pytest.approx(want[4:], abs=1e-6)
    held = [x for x in got.values() if x[0]]
    assert held and sum(x[5] for x in held) > sum(x[4] for x in held)


def test_op2_probabilities_sum_to_one(spark):
    """After any context, the words seen in training and one class for all others."""
    texts = [(i, f"a b {'ab'[i % 2]} c") for i in range(40)]
    probes = [(1000 + i, w) for i, w in enumerate(["a", "b", "c", "zzz", ""])]
    held = [p for p in range(5000, 9000) if zlib.crc32(str(p).encode()) % 7 == 2][: len(probes)]
    rows = texts + [(h, w) for h, (_, w) in zip(held, probes, strict=True)]
    rows = [r for r in rows if r[0] in held or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    got = by_id(lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")), "score")
    end = {h: got[h][0] for h in held}
    empty = end[held[4]]
    # log10 P(w) P(end | w): take the end token's part off with the plain version's help
    plain = {i: s for (i, _), s in zip(rows, (r[5] for r in brute.lm_scores(rows, lm.MASS)), strict=True)}
    assert all(end[h] == pytest.approx(plain[h], abs=1e-9) for h in held)
    assert 0 < 10 ** empty < 1


def test_op2_fails_state_by_state(spark):
    """A trigram, a bigram after an unseen pair and a lone word: each needs one failure arc more; copies score above single texts."""
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = ["a b c", "x b d", "one two three four", "five six seven eight", "five six seven eight"]
    probes = ["a b c", "a b d", "x d c", "zzz a b c", "one two three four", "five six seven eight"]
    rows = [*zip(train, texts, strict=False), *zip(held, probes, strict=False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(lm.score_texts(frame), "held_out", "n_tokens", "score", "mean_score")
    for (i, _), want in zip(rows, brute.lm_scores(rows, lm.MASS), strict=True):
        assert got[i][0] == want[0] and got[i][2:] == pytest.approx((want[5], want[5] / want[1]), abs=1e-9)
    score = {p: got[i][2] for i, p in zip(held, probes, strict=False)}
    assert score["a b c"] > score["a b d"] > score["x d c"]
    assert score["five six seven eight"] > score["one two three four"]


def test_op3_fingerprints(docs):
    got = by_id(ordermin.fingerprints(docs), "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    texts = [(i, t or "") for i, t in sorted(AWKWARD)]
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        assert got[i][:2] == (len(text), text[:len(text) - half] + after[:half])
        assert 0 <= got[i][4] <= 1 and 0 <= got[i][5] <= 1
    assert got[5][2] == got[6][2] and got[5][5] == 1.0
    assert got[1][2] == [] and got[1][5] == 1.0  # the next is empty as well
    assert got[7][2] != got[5][2]


def plain_fingerprint(hashes, gram_hash, key_hash):
    k = ordermin.K
    grams = [gram_hash(tuple(hashes[i:i + k])) for i in range(len(hashes) - k + 1)] if len(hashes) >= k else []
    seen, keys = {}, []
    for at, g in enumerate(grams):
        seen[g] = seen.get(g, -1) + 1
        keys.append((key_hash(g, seen[g]), at))
    return keys


def test_op3_selects_minima_in_text_order(spark):
    """The chosen k-mers are the smallest of each range, repeated ones by their numbers, hashed in text order."""
    texts = ["a b c d e f g h a b c d e f", "x y x y x y x y x y", " ".join(map(str, range(300))), "p q r", "p q"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(ordermin.with_fingerprint(df, "text", "fp"), "fp")

    def hashed(values, kinds):
        row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {t}" for i, t in enumerate(kinds)))
        return row.select(F.xxhash64(*row.columns)).collect()[0][0]

    for i in (0, 1):
        words = [hashed([w], ["string"]) for w in texts[i].split()]
        keys = plain_fingerprint(words, lambda g: hashed(g, ["long"] * 3), lambda g, n: hashed([g, n], ["long", "int"]))
        ranges = {}
        for h, at in sorted(keys):
            ranges.setdefault((h % 2**64) >> 58, []).append((h, at))
        assert [s[:2] for s in got[i][0]] == [f"{r:02X}" for r in ranges]
        for s, chosen in zip(got[i][0], ranges.values(), strict=True):
            ordered = [h for h, _ in sorted(chosen[: ordermin.PER_BIN], key=lambda x: x[1])]
            frame = spark.createDataFrame([(ordered,)], "a array<long>")
            assert s[2:] == frame.select(F.substring(F.lpad(F.hex(F.xxhash64("a")), 16, "0"), 5, 12)).collect()[0][0]
    assert len(got[4][0]) == 1


@pytest.mark.parametrize("buckets", [1, 5, 50])
def test_op3_next_rows(spark, buckets):
    rows = [(i * 7, f"t{i}") for i in range(40)] + [(7, "t0 again"), (None, "no id")]
    got = ordermin.with_next(spark.createDataFrame(rows, "_id long, text string").repartition(3), "_id", ["text"], buckets).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {r[1]: ordered[(k + 1) % len(ordered)][1] for k, r in enumerate(ordered)}
    assert {r["text"]: r["_next_text"] for r in got} == want and len(got) == len(rows)


def test_op4_licenses(docs):
    got = by_id(licenses.scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, text in AWKWARD:
        assert got[i][:5] == brute.license_places(text)
        found, best = brute.license_labels(text, licenses.STATEMENTS, licenses.THRESHOLD)
        assert set(filter(None, got[i][5].split(","))) == found | set(filter(None, got[i][4].split(",")))
        assert got[i][6] == pytest.approx(best)
    assert got[9][5] == "cc-by-nc,gpl,mit"


@pytest.mark.parametrize("threshold", [0.6, 0.75, 1.0])
def test_op4_thresholds(spark, threshold):
    chance = random.Random(4)
    vocabulary = "this is a license you may use the work under terms of x y z".split()
    statements = [("you may use the work under terms of license", "one"), ("this is a license", "two"), ("use the the work", "three")]
    rows = [(i, " ".join(chance.choice(vocabulary) for _ in range(chance.randint(0, 25)))) for i in range(60)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), statements=statements, threshold=threshold), "labels", "score")
    for i, text in rows:
        found, best = brute.license_labels(text, statements, threshold)
        assert (set(filter(None, got[i][0].split(","))), got[i][1]) == (found, pytest.approx(best))


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_op5_repeats(spark, hot):
    chance = random.Random(2)
    words = ["the", "éa", "ßx", "foo", "bar", "aaaa", "zz"]
    passages = [" ".join(chance.choice(words) + str(chance.randrange(9)) for _ in range(40)) for _ in range(6)]
    rows = [(i, " ".join(
        chance.choice(passages)[chance.choice([0, 0, 7]):chance.choice([150, 200, 90])] if chance.random() < 0.5
        else " ".join(chance.choice(words) + str(chance.randrange(99)) for _ in range(20)) for _ in range(5))) for i in range(50)]
    rows += [(100, "a" * 500), (101, "a" * 99), (102, "a" * 100), (103, None), (104, ""), (105, rows[3][1]), (106, rows[3][1]), (107, "ab" * 300),
             (108, "\x00" * 150), (109, "\x00" * 120 + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("n_bytes", F.lit("mine"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in repeats.dedup(df, hot=hot).collect()}
    assert got == brute.repeats(rows)


def test_op5_repeated_rows_and_missing_ids(spark):
    text, other = "q" * 50 + PARAGRAPH, PARAGRAPH[:120] + " something else entirely"
    rows = [(1, text), (1, text), (None, text), (2, other), (3, text)]
    got = [(r["doc_id"], r["n_removed"]) for r in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, 0), (2, 120), (3, len(text))], key=str)


def test_op5_maximal_repeats_list_all_occurrences():
    left = [b"cba", b"cbx", b"cba", b"zzz"]
    right = [b"hello", b"hello", b"help", b"hello"]
    found = {(a, b, tuple(sorted(m))) for a, b, m in repeats.maximal_repeats(left, right, 5)}
    assert (3, 3, (0, 2)) in found and (2, 5, (0, 1)) in found and (0, 5, (0, 1, 3)) in found


def test_op5_long_texts_are_cut_into_slices(monkeypatch):
    raw = np.random.default_rng(1).integers(97, 101, 5000, dtype=np.uint8).tobytes()
    whole = repeats.anchors(raw)
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)
    cut = repeats.anchors(raw)
    assert sum(last - first + 1 for first, last in zip(whole[2], whole[3], strict=True)) == len(raw) - 99
    assert sum(last - first + 1 for first, last in zip(cut[2], cut[3], strict=True)) == len(raw) - 99


def test_op5_query(spark, sf, given):
    assert by_id(QUERIES["op5_repeats"](spark, sf), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(listed(given))


def test_op6_line_dedup(docs, given):
    assert by_id(linededup.dedup(docs), "text", "n_lines_removed") == brute.plain_runs(AWKWARD)
    assert brute.plain_runs(AWKWARD)[12][1] > 0
    assert by_id(linededup.dedup(given), "text", "n_lines_removed") == brute.plain_runs(listed(given))


def test_op6_boundaries_resist_shifts():
    chance = np.random.default_rng(2)
    lines = [int(x) for x in chance.integers(0, 1 << 62, 2000)]
    starts = set(linededup.chunk_starts(lines))
    moved = {e - 1 for e in linededup.chunk_starts([7, *lines])}
    assert len(starts & moved) > 0.99 * len(starts) and len(starts) > 500


def test_op7_measures(docs):
    got = by_id(quality.judge(docs, measures=True), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.quality(t) for i, t in AWKWARD}


def test_op7_repeats_in_runs(spark):
    chance = random.Random(8)
    rows = [(i, " ".join(chance.choice("abc") for _ in range(chance.randint(0, 60)))) for i in range(80)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), measures=True), "n_repeat_words")
    assert got == {i: (brute.quality(t)[4],) for i, t in rows}


def test_op7_order_changes_no_verdict(given):
    verdicts = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        assert {r.name for r in quality.order_rules(given, rules)} == {r.name for r in rules}
        verdicts.append(by_id(quality.judge(given, rules), "kept"))
    assert verdicts[0] == verdicts[1] == by_id(quality.judge(given, measures=True), "kept")
    assert {i for i, (k,) in verdicts[0].items() if k} == {i for i, _ in listed(quality.keep(given))}


@pytest.mark.parametrize("seed", [3, 4])
def test_op8_groups(spark, seed):
    chance = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "x")]
    for _ in range(5):
        base = [chance.choice(vocabulary) for _ in range(chance.choice([6, 30, 120]))]
        for _ in range(30):
            copy = list(base)
            for _ in range(int(len(copy) * chance.choice([0, 0, 0.01, 0.02, 0.03, 0.04, 0.05]))):
                copy[chance.randrange(len(copy))] = chance.choice(vocabulary)
            rows.append((len(rows), " ".join(copy[: len(copy) - chance.choice([0, 0, 0, 5, 10])])))
    chance.shuffle(rows)
    got = by_id(jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "n_shingles", "component_id")
    assert got == brute.groups(rows)


def test_op8_keeps_one_of_each_group(docs):
    want = brute.groups(AWKWARD)
    assert by_id(jaccard.groups(docs), "n_shingles", "component_id") == want
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert {i for i, _ in listed(kept)} == {i for i, (_, c) in want.items() if i == c}


def test_op8_divide_skip():
    lists = [[1, 4, 9], [4, 9], [2, 9], [9]]
    assert jaccard.divide_skip(lists, 3, 1) == [(4, 2), (9, 4)]


def test_op8_query(spark, sf, given):
    assert by_id(QUERIES["op8_jaccard"](spark, sf), "n_shingles", "component_id") == brute.groups(listed(given))


def test_op9_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rows = [(i, f"http://h/{i}\r\nX: 1 é", f"<p>{'same' if i % 3 else i}</p>" * 20) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "u", "short"), (103, "u", "short"), (None, "u", "<p>same</p>" * 20), (5, "again", "<p>same</p>" * 20)]
    rows.append((104, "u", "\r\n\r\nWARC/1.1\r\n" * 30))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("payload", F.lit("mine"))
    manifest = warc.write_archives(pages)
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).collect()[0][0] == len(rows)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    payloads = {(i, h or "") for i, _, h in rows}
    for r in got:
        if r["record_type"] == "response":
            assert (r["page_id"], r["payload"].decode()) in payloads and r["refers_to"] is None
        else:
            assert r["payload"] is None and r["refers_to"] == 1
        assert "\n" not in r["url"]
    assert sum(r["record_type"] == "revisit" for r in got) == sum(1 for i, _, h in rows if h == "<p>same</p>" * 20 and i != 1)


def check_packing(pieces, rows, tokenizer):
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    sequences, found = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        found.setdefault(p["doc_id"], []).append((p["start"], ids, p["doc_tokens"]))
    total = padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    for i, texts in want.items():
        if len(texts) == 1:
            assert [x for _, ids, _ in sorted(found[i]) for x in ids] == texts[0]
            assert all(n == len(texts[0]) for _, _, n in found[i])
    assert set(found) == set(want)
    return padding / total if total else 0.0


def test_op10_packing(docs, given):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    check_packing(packing.pack(docs, BYTE_BPE).collect(), AWKWARD, tokenizer)
    assert check_packing(packing.pack(given, BYTE_BPE).collect(), listed(given), tokenizer) < 0.02


def test_op10_cuts_are_optimal():
    chance = random.Random(6)
    for _ in range(60):
        places = [0, *sorted(chance.sample(range(1, 60), chance.randint(1, 12)))]
        while max(b - a for a, b in zip(places, places[1:])) > 16:
            places = sorted({*places, *[(a + b) // 2 for a, b in zip(places, places[1:])]})
        cost = [0, *[chance.choice([0, 2, 16]) for _ in places[1:]]]
        best = [0, *[10**9] * (len(places) - 1)]
        price = lambda n: packing.SEQUENCE_COST + (0 if n & (n - 1) == 0 else 16 - n)
        for j in range(1, len(places)):
            for i in range(j):
                if places[j] - places[i] <= 16:
                    best[j] = min(best[j], best[i] + price(places[j] - places[i]) + cost[j])
        cuts = packing.best_cuts(np.array(places), np.array(cost), 16).tolist()
        assert sum(price(b - a) + cost[places.index(b)] for a, b in zip([0, *cuts[:-1]], cuts)) == best[-1]


EMPTY = {
    "bpe": lambda d: bpe.encode_decode(d, WORD_BPE), "lm": lm.score_texts, "ordermin": ordermin.fingerprints, "licenses": licenses.scan, "repeats": repeats.dedup,
    "lines": linededup.dedup, "quality": lambda d: quality.judge(d, measures=True), "jaccard": jaccard.groups, "keep_first": jaccard.keep_first,
    "packing": lambda d: packing.pack(d, BYTE_BPE),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_and_repeated_rows(spark, name):
    assert EMPTY[name](spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, PARAGRAPH), (1, PARAGRAPH), (None, PARAGRAPH), (None, None), (2, None), (2, LICENSE)]
    got = EMPTY[name](spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == (got.count() if name == "packing" else 6)


def test_empty_pages(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
