"""Removal of repeated byte strings with suffix arrays.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier: in a text of smaller id, or further
left in the same text. Strings never cross texts.

Suffixes are placed at anchors. Of each window of ``length`` bytes the anchor is the place of its smallest 24-byte hash,
so equal windows have their anchors at equal offsets, and about one byte in forty is an anchor. Only anchors whose hash
occurs twice are looked at. Around such an anchor its windows' bytes are taken: to the right they form an anchored
suffix, to the left a reversed prefix. Tasks receive all anchors of a hash, sort the suffixes, and compute the lengths of
the common prefixes of neighbours. A stack scan yields the tree of common-prefix intervals. Inside an interval of depth r
the members are sorted by their left sides and scanned in the same way; a set whose left sides agree for l bytes and then
differ is a maximal repeat of l + r bytes with all of its occurrences, if l + r reaches ``length``. Every occurrence but
the first loses those bytes. Any two equal windows meet in one such set, so the result is exact.

Hashes with more than ``HOT`` anchors do not go to one task: the windows of these anchors are grouped one by one, by
128-bit hashes and with pre-aggregated first places, which bears any number of occurrences.

Texts equal to an earlier text are settled first: from ``length`` bytes on they lose everything.

Defined results: a null text is empty and stays null; texts shorter than ``length`` stay whole. Rows that repeat id and
text count as one document; rows that repeat an id with another text are ordered by their text's hash. Rows without id
are not compared and stay whole. Where a removal leaves an incomplete character, its remaining bytes stay in
``kept_bytes`` and are dropped from ``text``. Extra columns stay; names beginning with ``_r_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from creditloom.llm.common import key_bits, passing, stored

LENGTH = 100
GRAM = 24
HOT = 50_000
CHUNK = 20_000  # anchors in one suffix array, unless a hash has more
PLACE_BITS = 24
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 24 bytes at every place."""
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(3):
        x = np.ndarray((n,), "<u8", data.data, 8 * i, (1,)).astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= _C[i]
        h += x
        h ^= h >> np.uint64(32)
    h *= _C[3]
    h ^= h >> np.uint64(31)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


def _slice_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = _gram_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    chosen = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low
    begins = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    place = chosen[begins].astype(np.int64)
    return h[place], place, begins, np.append(begins[1:], len(chosen)) - 1


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of every anchor, and the first and last start of the windows that it stands for."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < length:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    step = (1 << PLACE_BITS) - length
    parts = []
    for at in range(0, len(data) - length + 1, step):
        h, place, first, last = _slice_anchors(data[at:at + step + length - 1], length)
        parts.append((h, place + at, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _stack_scan(depths: list[int]) -> Iterator[tuple[int, int, int]]:
    """Intervals (depth, first, last) of a sorted list, given the common-prefix lengths of neighbours."""
    stack = [(0, 0)]
    for i, depth in enumerate([*depths, 0], 1):
        start = i - 1
        while stack[-1][0] > depth:
            own, start = stack.pop()
            yield own, start, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, start))


class Sides:
    """Byte strings as big numbers: sorting numbers sorts strings, and the highest differing bit tells the common prefix."""

    def __init__(self, strings: list[bytes], width: int):
        self.bits = 8 * width
        self.size = [len(s) for s in strings]
        self.number = [int.from_bytes(s.ljust(width, b"\0"), "big") for s in strings]

    def common(self, a: int, b: int) -> int:
        x = (self.bits - (self.number[a] ^ self.number[b]).bit_length()) >> 3
        return min(x, self.size[a], self.size[b])


def maximal_repeats(left: list[bytes], right: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Sets of anchors that agree for exactly ``l`` bytes to the left and ``r`` to the right, with l + r >= length.

    ``left`` holds reversed left sides. The right sides make the suffix array; its interval tree comes from a stack scan.
    """
    ahead, behind = Sides(right, length), Sides(left, length)
    order = sorted(range(len(right)), key=ahead.number.__getitem__)
    depths = [ahead.common(a, b) for a, b in zip(order, order[1:])]
    longest = max(behind.size, default=0)
    for r, first, last in _stack_scan(depths):
        if r + longest < length:
            continue
        if last == first + 1:
            a, b = order[first], order[last]
            if (common := behind.common(a, b)) + r >= length:
                yield common, r, [a, b]
            continue
        members = sorted(order[first:last + 1], key=behind.number.__getitem__)
        lefts = [behind.common(a, b) for a, b in zip(members, members[1:])]
        if r >= length:  # also those whose left sides differ at once
            yield 0, r, members
        for common, a, b in _stack_scan(lefts):
            if common + r >= length:
                yield common, r, members[a:b + 1]


CONTEXT = "_r_h long, _r_id long, _r_hash long, _r_place long, _r_left binary, _r_right binary"
SPAN = "_r_id long, _r_hash long, _r_start long, _r_end long"


def _table(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)],
                                      names=[n for n, _ in schema])


def _postings(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = [("_r_h", pa.int64()), ("_r_id", pa.int64()), ("_r_place", pa.int64())]
        for batch in batches:
            hs, owners, places, held = [], [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                h, place, _, _ = anchors(text.as_buffer().to_pybytes(), length)
                hs.append(h.view(np.int64))
                owners.append(np.full(len(h), doc.as_py(), np.int64))
                places.append(place)
                held += len(h)
                if held >= 1 << 18:
                    yield _table(schema, [np.concatenate(x) for x in (hs, owners, places)])
                    hs, owners, places, held = [], [], [], 0
            if hs:
                yield _table(schema, [np.concatenate(x) for x in (hs, owners, places)])

    return keyed.select("_r_id", "_r_text").mapInArrow(run, "_r_h long, _r_id long, _r_place long")


def _around(texts: DataFrame, length: int, windows: bool) -> DataFrame:
    """Per listed anchor its two sides, or with ``windows`` every window it stands for by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in (WINDOW if windows else CONTEXT).split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()] if not windows else [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        schema = list(zip(names, types, strict=True))
        for batch in batches:
            rows: list[tuple] = []
            for doc, text_hash, text, places in zip(*batch.columns, strict=True):
                raw = text.as_buffer().to_pybytes()
                doc, text_hash = doc.as_py(), text_hash.as_py()
                h, place, first, last = anchors(raw, length)
                pick = np.isin(place, places.values.to_numpy())
                for key, a, lo, hi in zip(*(x[pick].tolist() for x in (h.view(np.int64), place, first, last)), strict=True):
                    if windows:
                        rows += [(xxhash.xxh128_digest(raw[p:p + length]), doc, text_hash, p) for p in range(lo, hi + 1)]
                    else:
                        rows.append((key, doc, text_hash, a, raw[lo:a][::-1], raw[a:hi + length]))
                if len(rows) >= 20_000:
                    yield _table(schema, list(zip(*rows, strict=True)))
                    rows = []
            if rows:
                yield _table(schema, list(zip(*rows, strict=True)))

    return texts.mapInArrow(run, WINDOW if windows else CONTEXT)


WINDOW = "_r_window binary, _r_id long, _r_hash long, _r_start long"


def _later_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of all occurrences of maximal repeats but the first. Rows come sorted by hash, id, text hash, place and sides."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        # Rows that repeat id and text are one document. An anchor at the border of two slices comes once for the windows of each.
        mark = [table[c].to_numpy() for c in ("_r_h", "_r_id", "_r_hash", "_r_place")] + [
            pc.binary_length(table[c]).to_numpy() for c in ("_r_left", "_r_right")]
        fresh = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in mark], axis=0)])
        if not fresh.all():
            table = table.filter(pa.array(fresh))
        left, right = table["_r_left"].to_pylist(), table["_r_right"].to_pylist()
        place = table["_r_place"].to_pylist()
        spans: set[tuple[int, int, int]] = set()
        for common, r, members in maximal_repeats(left, right, length):
            first = min(members)
            for m in members:
                if m != first:
                    spans.add((m, place[m] - common, place[m] + r))
        found = sorted(spans)
        at = pa.array([m for m, _, _ in found], pa.int64())
        return _table([("_r_id", pa.int64()), ("_r_hash", pa.int64()), ("_r_start", pa.int64()), ("_r_end", pa.int64())],
                      [table["_r_id"].take(at).combine_chunks(), table["_r_hash"].take(at).combine_chunks(), [a for _, a, _ in found], [b for _, _, b in found]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            keys = table["_r_h"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last hash may go on
            if whole:
                yield solve(table.slice(0, whole))
                held, rows = table.slice(whole).to_batches(), len(keys) - whole
        if rows:
            yield solve(pa.Table.from_batches(held))

    ordered = contexts.repartition("_r_h").sortWithinPartitions(
        "_r_h", "_r_id", "_r_hash", "_r_place", F.octet_length("_r_left"), F.octet_length("_r_right"))
    return ordered.mapInArrow(run, SPAN)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]


def spans(keyed: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``_r_id, _r_hash, _r_starts, _r_ends``: the byte ranges that go, for every text that loses any. ``keyed``: _r_id, _r_hash, _r_text."""
    keyed = keyed.where("_r_id is not null")
    profile = stored(keyed.select("_r_id", "_r_hash", F.octet_length("_r_text").cast("long").alias("_r_n"), F.sha2("_r_text", 256).alias("_r_digest")), "repeats-texts")
    same = profile.where(F.col("_r_n") >= length).groupBy("_r_digest", "_r_n").agg(
        F.min(F.struct("_r_id", "_r_hash")).alias("_r_first"), F.max(F.struct("_r_id", "_r_hash")).alias("_r_last")).where("_r_first <> _r_last")
    copies = stored(
        profile.join(same, ["_r_digest", "_r_n"]).where(F.struct("_r_id", "_r_hash") != F.col("_r_first")).select("_r_id", "_r_hash", "_r_n").distinct(), "repeats-copies")
    postings = _postings(keyed, length)
    often = stored(postings.groupBy("_r_h").agg(F.count(F.lit(1)).alias("_r_often")).where("_r_often > 1"), "repeats-hashes")
    listed = (
        postings.join(often, "_r_h").groupBy("_r_id").agg(
            F.collect_set(F.when(F.col("_r_often") <= hot, F.col("_r_place"))).alias("_r_few"),
            F.collect_set(F.when(F.col("_r_often") > hot, F.col("_r_place"))).alias("_r_many"))
    )
    listed = stored(listed, "repeats-places")
    texts = passing(keyed, key_bits(listed, "_r_id"), ["_r_id"], True).join(listed, "_r_id").join(copies.drop("_r_n"), ["_r_id", "_r_hash"], "left_anti")
    found = _later_spans(_around(texts.where(F.size("_r_few") > 0).select("_r_id", "_r_hash", "_r_text", "_r_few"), length, False), length)
    if not often.where(F.col("_r_often") > hot).isEmpty():
        windows = _around(texts.where(F.size("_r_many") > 0).select("_r_id", "_r_hash", "_r_text", "_r_many"), length, True)
        firsts = windows.groupBy("_r_window").agg(F.min(F.struct("_r_id", "_r_hash", "_r_start")).alias("_r_first"), F.count(F.lit(1)).alias("_r_often"))
        again = windows.join(firsts.where("_r_often > 1"), "_r_window").where(F.struct("_r_id", "_r_hash", "_r_start") != F.col("_r_first"))
        found = found.unionByName(again.select("_r_id", "_r_hash", "_r_start", (F.col("_r_start") + length).alias("_r_end")))
    found = found.unionByName(copies.select("_r_id", "_r_hash", F.lit(0).cast("long").alias("_r_start"), F.col("_r_n").alias("_r_end")))
    return found.groupBy("_r_id", "_r_hash").agg(F.collect_list(F.struct("_r_start", "_r_end")).alias("_r_spans")).select(
        "_r_id", "_r_hash", F.col("_r_spans._r_start").alias("_r_starts"), F.col("_r_spans._r_end").alias("_r_ends"))


RESULTS = [("n_bytes", LongType(), pa.int64()), ("n_removed", LongType(), pa.int64()), ("n_spans", LongType(), pa.int64()), ("kept_bytes", BinaryType(), pa.binary())]


def _cut(rows: DataFrame, text_col: str) -> DataFrame:
    kept = [f for f in rows.schema.fields if not f.name.startswith("_r_")]
    names = [f.name for f in kept]
    at = names.index(text_col)
    schema = StructType([*[StructField(f.name, StringType()) if f.name == text_col else f for f in kept], *[StructField(n, t) for n, t, _ in RESULTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):  # a row leaves twice as long as it came
            texts, results = [], []
            for text, starts, ends in zip(batch.column(at), batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not starts.is_valid or not len(starts):
                    texts.append(text.as_py())
                    results.append((len(raw), 0, 0, raw))
                    continue
                a, b = _merged(starts.values.to_numpy(), ends.values.to_numpy())
                left = b"".join([raw[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)])
                texts.append(left.decode("utf-8", "ignore"))
                results.append((len(raw), len(raw) - len(left), len(a), left))
            arrays = list(batch.columns[:len(names)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c, t) for c, (_, _, t) in zip(zip(*results, strict=True), RESULTS, strict=True)]],
                                             names=[*names, *[n for n, _, _ in RESULTS]])

    return rows.select(*[f"`{n}`" for n in names], "_r_starts", "_r_ends").mapInArrow(run, schema)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The rows with repeated strings cut from ``text_col``, and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_bytes``.

    Only texts that may lose bytes are shuffled to meet their spans; a bit map of fixed size tells the others apart.
    """
    results = [n for n, _, _ in RESULTS]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.drop(*results).withColumns({"_r_id": F.col(f"`{id_col}`").cast("long"), "_r_hash": F.xxhash64(text)})
    going = stored(spans(rows.select("_r_id", "_r_hash", text.alias("_r_text")), length, hot), "repeats-spans")
    bits, key = key_bits(going, "_r_id", "_r_hash"), ["_r_id", "_r_hash"]
    none = F.lit(None).cast("array<bigint>")
    hit = passing(rows, bits, key, True).join(going, key, "left")
    missed = passing(rows, bits, key, False).withColumns({"_r_starts": none, "_r_ends": none})
    return _cut(hit.unionByName(missed), text_col)
