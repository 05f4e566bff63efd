"""Jaccard join on word shingles by T-occurrence search, and the groups that its links form.

Shingles are ordered by their frequency over all texts, rarest first. Of a text with n shingles every partner shares at least
ceil(0.75 n), so it shares one of the first n - ceil(0.75 n) + 1: these short lists are merged, the long lists of the
other shingles are only probed. The search has two steps, so that a group of many near copies is never expanded into
its pairs:

1. Every text of a short list is compared with the list's smallest one; links join texts into components.
2. Between texts of different components DivideSkip runs. A pair of n and m shingles needs ceil(3 (n + m) / 7) in common,
   of which at most ceil(0.75 max(n, m)) - 1 lie outside the short lists; so it needs T common short lists. A text's lists
   are ranked by length; the longest T // 2 are set aside, the others are merged with a heap, and texts found often enough
   are compared by binary probes into the sorted shingles, which stand for all lists set aside.

Texts with equal shingle sets are one node from the start. Words and shingles are 64-bit hashes.

Defined results: a null or empty text has no shingles and is linked with nothing. Rows that repeat an id count as one
node; a null id is linked with nothing and has no component. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import (LOWER_BYTES, WordHashes, bounds, connected, key_bits, pack, pack_sorted, passing, squeezed,
                                   stored, unpack, unpack_sorted)

SHINGLE = 5
SHORT = np.uint64(16)
BLOCK_BYTES = 4 << 20
BLOCK = 4096
BAND = 1.1
_hashes = WordHashes()
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of a text in UTF-8; with fewer words one hash of them all."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    rolled = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        rolled = rolled * _FACTOR + h[i:len(h) - size + 1 + i]
    rolled ^= rolled >> np.uint64(31)
    rolled *= _MIX
    rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def least_shared(n: int) -> int:
    """Shingles that any partner of a text with n shingles shares with it."""
    return -(-3 * n // 4)


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _rare_first(keyed: DataFrame) -> DataFrame:
    """One row per text (kind 0: ``id, n, s1, s2``, the last two naming its shingle set) and one per posting (kind 1:
    ``h, id``): the rarest shingles of a text, enough that any partner shares one, without those no other text has.
    Texts with postings bring their sorted shingles along.

    Texts are dealt into blocks. A block sends its distinct shingles with counts to hash ranges, and each range answers
    with totals in the order of the block's own list. Counts go by the upper 48 bits of a hash: two shingles that share
    them look more frequent than they are, which makes lists longer but loses nothing.
    """
    spark = keyed.sparkSession
    size = keyed.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks, ranges = max(1, -(-size // BLOCK_BYTES)), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = squeezed(keyed.select("id", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block"), F.coalesce("text", F.lit("")).alias("text")))

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [shingles(zstandard.decompress(t)) for t in table["packed"].to_pylist()]

    def short(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.empty(0, np.uint64), *sets]) >> SHORT, return_counts=True)

    def send(table: pa.Table) -> pa.Table:
        keys, counts = short(sets_of(table))
        at, out = bounds(keys << SHORT, ranges), []
        for r in range(ranges):
            a, b = at[r], at[r + 1]
            if a < b:
                out.append((r, table["block"][0].as_py(), pack_sorted(keys[a:b]), pack(counts[a:b])))
        return pa.Table.from_batches([_batch(["range", "block", "keys", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()], out)])

    def add(table: pa.Table) -> pa.Table:
        lists = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        totals = np.bincount(at, counts, len(keys)).astype(np.uint64)[at]
        parts = np.split(totals, np.cumsum([len(x) for x in lists])[:-1])
        out = [(b, r, pack(t)) for b, r, t in zip(table["block"].to_pylist(), table["range"].to_pylist(), parts, strict=True)]
        return pa.Table.from_batches([_batch(["block", "range", "totals"], [pa.int64(), pa.int64(), pa.binary()], out)])

    def choose(texts: pa.Table, answers: pa.Table) -> pa.Table:
        sets = sets_of(texts)
        keys, _ = short(sets)
        often = np.concatenate([np.empty(0, np.uint64), *[unpack(x) for x in answers.sort_by("range")["totals"].to_pylist()]])
        out: list[tuple] = []
        for doc, s in zip(texts["id"].to_pylist(), sets, strict=True):
            count = often[np.searchsorted(keys, s >> SHORT)]
            take = len(s) - least_shared(len(s)) + 1 if len(s) and doc is not None else 0
            first = np.lexsort((s, count))[:take]
            first = s[first[count[first] > 1]].view(np.int64).tolist()
            d = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
            out.append((0, doc, len(s), int(d[0]), int(d[1]), None, s.tobytes() if first else None))
            out += [(1, doc, None, None, None, h, None) for h in first]
        names = ["kind", "id", "n", "s1", "s2", "h", "own"]
        return pa.Table.from_batches([_batch(names, [pa.int32(), *[pa.int64()] * 5, pa.binary()], out)])

    lists = rows.groupBy("block").applyInArrow(send, "range long, block long, keys binary, counts binary")
    answers = lists.groupBy("range").applyInArrow(add, "block long, range long, totals binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        choose, "kind int, id long, n long, s1 long, s2 long, h long, own binary")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose shingle sets reach the similarity, by binary probes of the smaller set into the larger."""
    pairs = stored(pairs, "jaccard-pairs")
    ends = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    sets = passing(sets, key_bits(ends, "id"), ["id"], True)
    both = (
        pairs.join(sets.select(F.col("id").alias("u"), F.col("own").alias("a")), "u")
        .join(sets.select(F.col("id").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int(np.count_nonzero(b[at] == a))
                keep.append(100 * shared >= 75 * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def divide_skip(lists: list[list[int]], least: int, skipped: int) -> list[tuple[int, int]]:
    """Ids with their counts that stand in at least ``least - skipped`` of the sorted short lists."""
    found = ((k, sum(1 for _ in same)) for k, same in groupby(heapq.merge(*lists)))
    return [(k, c) for k, c in found if c >= least - skipped]


def _needed(n: Column, m: Column) -> Column:
    """Common short lists that a linked pair of n and m shingles has at least."""
    shared = F.ceil((n + m) * 3 / 7 - 1e-9)
    return F.greatest(shared - F.ceil(F.greatest(n, m) * 3 / 4 - 1e-9) + 1, F.lit(1))


def _search(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Candidate pairs ``u, v`` between components. ``lists``: h, id, n."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND)))
    rows = (
        lists.join(comps, F.col("id") == F.col("node"), "left")
        .select("h", "id", "n", F.coalesce("component", "id").alias("component"), band.cast("int").alias("band"))
    )
    open_lists = rows.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("h")
    rows = stored(rows.join(open_lists, "h"), "jaccard-open")
    sizes = rows.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    askers = rows.join(sizes, "h").where("component <> main").select("id").distinct()
    # Lists by length band: lengths of partners lie within a ratio of 3 to 4, so few bands matter for a text.
    bands = rows.groupBy("h", "band").agg(
        F.count(F.lit(1)).alias("length"), F.min("n").alias("least_n"), F.max("n").alias("most_n"),
        F.min("component").alias("low"), F.max("component").alias("high"))
    asked = (
        rows.join(askers, "id").alias("q").join(bands.alias("b"), "h")
        .where("b.most_n * 4 >= q.n * 3 and b.least_n * 3 <= q.n * 4 and not (b.low = q.component and b.high = q.component)")
        .select("h", "id", "n", "component", F.col("b.band").alias("band"), "length", "least_n", "most_n")
    )
    whole = Window.partitionBy("id", "band")
    n = F.col("n")
    # Without rounding the bound falls as lengths part from n, so its least value is at an end of the band; rounding takes 1.
    least = F.greatest(F.least(_needed(n, F.min("least_n").over(whole)), _needed(n, F.max("most_n").over(whole))) - 1, F.lit(1))
    asked = asked.withColumns({"least": least, "lists": F.count(F.lit(1)).over(whole)}).where("lists >= least")
    asked = asked.withColumn("skipped", F.floor(F.col("least") / 2)).withColumn(
        "place", F.row_number().over(whole.orderBy("length", "h"))).where("place <= lists - skipped")
    # Members are dealt into blocks by their own hash, the same way in every list, so that no group holds more than a block of each.
    longest = bands.agg(F.max("length")).collect()[0][0] or 0
    block = F.pmod(F.xxhash64("id"), F.lit(-(-longest // BLOCK) or 1)).alias("block")
    members = rows.groupBy("h", "band", block).agg(F.sort_array(F.collect_list(F.struct("id", "n", "component"))).alias("members"))
    met = asked.join(members, ["h", "band"]).select(
        "id", "band", "block", "n", "component", F.col("least").cast("long").alias("least"), F.col("skipped").cast("long").alias("skipped"),
        F.col("members.id").alias("ids"), F.col("members.n").alias("ns"), F.col("members.component").alias("comps"))

    def merge(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        own, n, component = first["id"], first["n"], first["component"]
        size: dict[int, int] = {}
        short = []
        for ids, ns, comps in zip(table["ids"].to_pylist(), table["ns"].to_pylist(), table["comps"].to_pylist(), strict=True):
            near = [(i, m) for i, m, c in zip(ids, ns, comps, strict=True) if c != component and 3 * n <= 4 * m and 3 * m <= 4 * n]
            size.update(near)
            short.append([i for i, _ in near])
        pairs = []
        for other, count in divide_skip(short, first["least"], first["skipped"]):
            m = size[other]
            need = max(-(-3 * (n + m) // 7) - least_shared(max(n, m)) + 1, 1)
            if count >= need - first["skipped"]:
                pairs.append((min(own, other), max(own, other)))
        return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})

    return met.groupBy("id", "band", "block").applyInArrow(merge, "u long, v long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row."""
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = stored(_rare_first(keyed), "jaccard-texts")
    rows, postings = made.where("kind = 0"), made.where("kind = 1").select("h", "id")
    same = rows.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    node = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id"))
    named = stored(rows.select("id", "n", "s1", "s2").join(same, ["s1", "s2"], "left").select("id", "n", node.alias("rep")), "jaccard-nodes")

    def repeated(p: DataFrame) -> DataFrame:
        return p.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("h")

    node_of = named.where("n > 0 and id is not null").select("id", "n", "rep")
    lists = postings.join(node_of, "id").select("h", F.col("rep").alias("id"), "n").distinct()
    lists = stored(lists, "jaccard-collapsed")
    lists = stored(lists.join(repeated(lists), "h"), "jaccard-lists")
    sets = rows.where("own is not null").select("id", "own")
    first = lists.groupBy("h").agg(F.min(F.struct("id", "n")).alias("first"))
    stars = (
        lists.join(first, "h").where("id <> first.id and n * 4 >= first.n * 3 and first.n * 4 >= n * 3")
        .select(F.col("first.id").alias("u"), F.col("id").alias("v")).distinct()
    )
    links = stored(_linked(stars, sets), "jaccard-links")
    comps = connected(links, "jaccard-first")
    across = stored(_linked(_search(lists, comps), sets), "jaccard-links")
    comps = connected(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(across), "jaccard-all")
    return named.join(comps, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows but one of each group: the smallest id stays. Rows without id stay."""
    gone = groups(docs, id_col, text_col).where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
