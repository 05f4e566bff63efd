"""Removal of repeated runs of lines by content-defined chunks.

Only lines with a visible character count as lines here; blank lines between two of them belong to the run. A hash rolls
over the hashes of ``WINDOW`` lines. Where it has a local minimum a chunk begins: boundaries depend on nearby lines alone, so
inserting or deleting lines elsewhere moves no other one, and no chunk has less than ``MIN_LINES`` lines.

1. Chunks that occur more than once in the whole corpus are compared byte by byte with their first occurrence (smallest
   id, then place) and removed when equal.
2. What is left is extended to its neighbours line by line: every two lines that follow each other and do not both lie in
   a removed chunk are a unit as well, across boundaries too, found and compared in the same way. The union of the units
   is every run of ``MIN_LINES`` or more lines that stands earlier in the corpus. A pair of lines that overlaps its own first
   occurrence (one line three times in a row) is no repeat.

Step 2 loses nothing by leaving the removed chunks out: their pairs of lines stand in the chunk's first occurrence too.

Only unit hashes are grouped, after pre-aggregation; only units whose hash repeats travel with their bytes, in a plain
join that adaptive execution splits when one unit is very common, and only texts that lose lines are shuffled, each compressed.

Defined results: a null text is treated as empty and stays null; texts without repeated runs stay byte for byte, and blank lines
at the ends of a run stay. Rows that repeat id and text count as one document and get equal results; rows that repeat an id with another text
are ordered by their text's hash; rows without id keep their lines. A text may become empty; its row stays. Extra columns
stay; columns named ``n_lines`` or ``n_lines_removed`` are replaced; names beginning with ``_l_`` raise a ValueError. A column ``n_chars`` is not touched here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from creditloom.llm.common import has_bit, key_bits, passing, squeezed, stored

WINDOW = 2
MIN_LINES = 2
ROWS = 256  # texts held as lines at once
UNITS = 8192  # units that leave a task's worker at once
SLOTS = 32  # of a bit map for each key
FACTOR = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
Span = tuple[int, int]


def chunk_starts(hashes: list[int], window: int = WINDOW) -> list[int]:
    """First lines of the chunks of a list of line hashes: 0 and the local minima of the hash that rolls over ``window`` of them."""
    top = pow(FACTOR, window, 1 << 64)
    rolled, at = [], 0
    for i, h in enumerate(hashes):
        at = (at * FACTOR + h) & MASK
        if i >= window:
            at = (at - top * hashes[i - window]) & MASK
        rolled.append((at * FACTOR & MASK) >> 16)
    return [0, *[i for i in range(MIN_LINES, len(hashes) - MIN_LINES + 1) if rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1]]]


def visible(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the places of those with a visible character."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def chunks(lines: list[str], seen: list[int]) -> list[Span]:
    """First and last (exclusive) of the visible lines of every chunk that can be removed."""
    if len(seen) < MIN_LINES:
        return []
    starts = chunk_starts([xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass")) for i in seen])
    return list(zip(starts, [*starts[1:], len(seen)], strict=True))


def pairs(n: int, gone: list[Span]) -> list[Span]:
    """Every two visible lines that follow each other and do not both lie in one removed chunk."""
    inside = {k for a, b in gone for k in range(a, b - 1)}
    return [(k, k + 2) for k in range(n - 1) if k not in inside]


UNIT_SCHEMA = "_l_id long, _l_hash long, _l_start long, _l_end long, _l_unit binary, _l_bytes binary"
UNIT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
KEY = ["_l_id", "_l_hash"]


def _unit_rows(texts: DataFrame, second: bool, bits: np.ndarray | None, taken: np.ndarray) -> DataFrame:
    """The chunks, or in the ``second`` step the pairs, of all texts by hash; with ``bits`` only those whose hash the bit map may hold, with their bytes.

    ``texts``: _l_id, _l_hash, _l_text, _l_packed, _l_starts, _l_ends naming removed chunks, _l_slot; rows whose slot ``taken`` has are left out."""
    context = texts.sparkSession.sparkContext
    shared, without = None if bits is None else context.broadcast(bits), context.broadcast(taken)
    names = [x.split(" ")[0] for x in UNIT_SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, UNIT_TYPES, strict=True)], names=names)

    def units(text: str, starts: list[int] | None, ends: list[int] | None) -> Iterator[tuple[int, int, bytes, bytes | None]]:
        lines, seen = visible(text)
        found = pairs(len(seen), list(zip(starts or [], ends or [], strict=True))) if second else chunks(lines, seen)
        for a, b in found:
            raw = "\n".join(lines[seen[a]:seen[b - 1] + 1]).encode("utf-8", "surrogatepass")
            digest = xxhash.xxh128_digest(raw)
            if shared is None:
                yield a, b, digest, None
            elif has_bit(shared.value, np.int64(xxhash.xxh64_intdigest(digest, 42) & (8 * len(shared.value) - 1))):  # as xxhash64() has it
                yield a, b, digest, raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in (_fresh(b.slice(i, ROWS), without.value) for b in batches for i in range(0, b.num_rows, ROWS)):
            for doc, text_hash, text, packed, starts, ends in zip(*batch.columns[:6], strict=True):
                own = doc.as_py(), text_hash.as_py()
                for unit in units(_text(text, packed), starts.as_py(), ends.as_py()):
                    rows.append((*own, *unit))
                    if len(rows) >= UNITS:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    return texts.select(*KEY, "_l_text", "_l_packed", "_l_starts", "_l_ends", "_l_slot").mapInArrow(run, UNIT_SCHEMA)


def repeated_units(rows: Callable[[np.ndarray | None], DataFrame], name: str) -> DataFrame:
    """``_l_id, _l_hash, _l_start, _l_end`` of every unit whose bytes stand earlier. ``rows`` gives the units, with bytes if it gets a bit map.

    The bytes of first occurrences are found by a bit map of their places: what else passes is later and loses against the first."""
    place, at = F.struct(*KEY, "_l_start"), ["_l_unit", *KEY, "_l_start"]
    repeated = stored(rows(None).groupBy("_l_unit").agg(F.min(place).alias("_l_first"), F.max(place).alias("_l_last")).where(
        "_l_first <> _l_last").select("_l_unit", "_l_first.*"), f"lines-{name}")
    bodies = stored(rows(key_bits(repeated, "_l_unit", each=SLOTS)), f"lines-{name}-bytes")
    firsts = stored(passing(bodies, key_bits(repeated, *at, each=SLOTS), at, True).groupBy("_l_unit").agg(
        F.min(F.struct(*KEY, "_l_start", "_l_bytes")).alias("_l_kept")), f"lines-{name}-firsts")
    first = F.struct("_l_kept._l_id", "_l_kept._l_hash", "_l_kept._l_start")
    return bodies.join(firsts, "_l_unit").where((place > first) & (F.col("_l_bytes") == F.col("_l_kept._l_bytes"))).select(*KEY, "_l_start", "_l_end")


def _spans(units: DataFrame, starts: str, ends: str) -> DataFrame:
    """The units of a text as two lists; a text has no more of them than lines."""
    lists = units.distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("_l_start", "_l_end"))).alias("_l_list"))
    return lists.select(*KEY, F.col("_l_list._l_start").alias(starts), F.col("_l_list._l_end").alias(ends))


def _beside(rows: DataFrame, text_col: str, spans: DataFrame, columns: list[str], name: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """The rows with the lists of their text, and a bit map. Only rows that may have lists are shuffled, with their text compressed in ``_l_packed``.

    They come first; all rows follow with empty lists and their slot in ``_l_slot``. Who reads them leaves out those whose slot is set, by ``_fresh``."""
    bits = key_bits(spans, *KEY, each=SLOTS)
    text = F.col(f"`{text_col}`")
    others = [f"`{c}`" for c in rows.columns if c != text_col]
    found = squeezed(passing(rows.where(text.isNotNull()), bits, KEY, True).select(*others, text), "_l_packed")
    hit = found.join(spans, KEY, "left").withColumns({text_col: F.lit(None).cast("string"), "_l_slot": F.lit(None).cast("bigint")})
    if name:
        hit = stored(hit, name)
    none: dict[str, Column] = {c: F.lit(None).cast("array<bigint>") for c in columns} | {"_l_packed": F.lit(None).cast("binary")}
    slot = F.when(F.col("_l_id").isNotNull() & text.isNotNull(), F.pmod(F.xxhash64(*KEY), F.lit(8 * len(bits))))
    return hit.unionByName(rows.withColumns({**none, "_l_slot": slot})), bits


def _text(text: pa.Scalar, packed: pa.Scalar) -> str | None:
    """A text that is there as it is or compressed."""
    return zstandard.decompress(packed.as_py()).decode("utf-8") if packed.is_valid else text.as_py()


def _fresh(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose slot, the last column, is null or not set."""
    slot = batch.column(batch.num_columns - 1)
    known = slot.is_valid().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(~(known & has_bit(bits, slot.fill_null(0).to_numpy()))))


def _gone_lines(lines: list[str], seen: list[int], removed: list[Span], drop: list[int]) -> set[int]:
    """Places of the lines that go, given the removed chunks and the first lines of the repeated pairs."""
    units = {*drop, *[k for a, b in removed for k in range(a, b - 1)]}
    gone = {i for a, b in removed for i in range(seen[a], seen[b - 1] + 1)}
    for k in drop:
        own = lines[seen[k]:seen[k + 1] + 1]
        if not k or k - 1 in units or own != lines[seen[k - 1]:seen[k] + 1]:
            gone.update(range(seen[k], seen[k + 1] + 1))
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all repeated runs of lines removed from ``text_col``, and ``n_lines`` and ``n_lines_removed``."""
    if reserved := [c for c in docs.columns if c.startswith("_l_")]:
        raise ValueError(f"reserved column names: {reserved}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select("*", F.col(f"`{id_col}`").cast("long").alias("_l_id"), F.xxhash64(text).alias("_l_hash"))
    keyed = rows.where("_l_id is not null").select(*KEY, text.alias("_l_text"))
    lists = {c: F.lit(None).cast("array<bigint>") for c in ("_l_starts", "_l_ends")}
    bare = keyed.withColumns({**lists, "_l_packed": F.lit(None).cast("binary"), "_l_slot": F.lit(None).cast("bigint")})
    nothing = np.zeros(8, np.uint8)
    removed = stored(_spans(repeated_units(lambda bits: _unit_rows(bare, False, bits, nothing), "chunks"), "_l_starts", "_l_ends"), "lines-removed")
    left, taken = _beside(keyed, "_l_text", removed, ["_l_starts", "_l_ends"], "lines-left")
    more = _spans(repeated_units(lambda bits: _unit_rows(left, True, bits, taken), "pairs"), "_l_drop", "_l_drop_end").drop("_l_drop_end")
    drops = stored(removed.join(more, KEY, "full"), "lines-drops")
    joined, changed = _beside(rows, text_col, drops, ["_l_starts", "_l_ends", "_l_drop"])
    without = docs.sparkSession.sparkContext.broadcast(changed)
    counts = ("n_lines", "n_lines_removed")
    kept = [f for f in docs.schema.fields if f.name not in counts]
    names = [f.name for f in kept]
    at = names.index(text_col)
    schema = StructType([*[StructField(f.name, StringType()) if f.name == text_col else f for f in kept], *[StructField(c, LongType()) for c in counts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (_fresh(b.slice(i, ROWS), without.value) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts, n_lines, n_removed = [], [], []
            for text, packed, *spans in zip(batch.column(at), *batch.columns[len(names):-1], strict=True):
                text, (starts, ends, drop) = _text(text, packed), (s.as_py() or [] for s in spans)
                if not starts and not drop:
                    texts.append(text)
                    n_lines.append(text.count("\n") + 1 if text else 0)
                    n_removed.append(0)
                    continue
                lines, seen = visible(text)
                gone = _gone_lines(lines, seen, list(zip(starts, ends, strict=True)), drop)
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in gone]))
                n_lines.append(len(lines))
                n_removed.append(len(gone))
            arrays = list(batch.columns[:len(names)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, *counts])

    return joined.select(*[f"`{n}`" for n in names], "_l_packed", "_l_starts", "_l_ends", "_l_drop", "_l_slot").mapInArrow(run, schema)


dedup_runs = dedup
