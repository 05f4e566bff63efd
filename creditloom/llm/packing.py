"""Order-preserving packing of documents into training sequences.

Documents keep their order; each is its ids followed by one end id. Within a block of documents dynamic programming
chooses where the windows end. A window of at most 1024 ids costs its padding (none at a power of two, where it is
not padded), a little for being a sequence at all, and what its cut breaks: nothing at a document's end, little at a
sentence's end, more inside a sentence. With ``g(i) = cost(i) + position(i)`` the padded transition is the minimum of g
over a sliding range of cut places, which a monotone queue yields in constant time; exact powers of two are the other
transitions.

Cut places are the ends of documents and sentences; where these lie further apart than ``GAP`` ids, every ``GAP``-th id
between them, so that no window is left mostly empty by a long sentence.

Defined results: a null or empty text is its end id alone. Repeated rows are packed as often as they occur. Extra
columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from creditloom.llm.bpe import byte_letters

WINDOW = 1024
BLOCK_IDS = 1 << 18
GAP = 32
SEQUENCE_COST = 4
SENTENCE_CUT = 2
WORD_CUT = 16
#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PieceTokenizer:
    """The ids of texts for a byte-level vocabulary file. A text is split at special tokens and encoded as it comes; nothing is kept between texts."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.core = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.apart = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.sentence_end = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, dtype=bool)
        self.sentence_end[[i for word, i in ranks.items() if word.endswith((b".", b"!", b"?", b"\n"))]] = True

    def _plain(self, piece: str) -> bytes:
        return array("I", self.core.encode_ordinary(piece)).tobytes()

    def _ids(self, text: str) -> bytes:
        if self.apart is None or not self.apart.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [self._plain(text[at:m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str | None) -> bytes:
        return self._ids(text) if text else b""


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, from 0 to the last document's end, and what a cut there costs."""
    total = int(doc_ends[-1])
    ends = np.union1d(sentence_ends, doc_ends)
    ends = np.union1d(ends[ends > 0], [0])
    spans = np.diff(ends)
    extra = [np.arange(a + gap, b, gap) for a, b in zip(ends[:-1][spans > 2 * gap], ends[1:][spans > 2 * gap], strict=True)]
    places = np.union1d(ends, np.concatenate(extra)) if extra else ends
    cost = np.full(len(places), WORD_CUT, dtype=np.int64)
    cost[np.isin(places, sentence_ends, assume_unique=False)] = SENTENCE_CUT
    cost[np.isin(places, doc_ends, assume_unique=False)] = 0
    cost[0] = 0
    assert places[-1] == total
    return places.astype(np.int64), cost


def best_cuts(places: np.ndarray, cut_cost: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The chosen ends of windows, by dynamic programming over the cut places with a monotone queue."""
    m = len(places)
    exact: list[list[int]] = [[] for _ in range(m)]
    power = 1
    while power <= window:
        at = np.searchsorted(places, places - power)
        hit = np.flatnonzero((places >= power) & (places[np.minimum(at, m - 1)] == places - power))
        for j, i in zip(hit.tolist(), at[hit].tolist(), strict=True):
            exact[j].append(i)
        power *= 2
    pos, pen = places.tolist(), cut_cost.tolist()
    cost, came = [0] * m, [0] * m
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, place), costs rising from the left
    for j in range(1, m):
        p = pos[j]
        while pos[queue[0][1]] < p - window:
            queue.popleft()
        g, i = queue[0]
        best = g + window - p
        for k in exact[j]:
            if cost[k] < best:
                best, i = cost[k], k
        best += pen[j] + SEQUENCE_COST
        cost[j], came[j] = best, i
        g = best + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j))
    cuts, j = [], m - 1
    while j:
        cuts.append(pos[j])
        j = came[j]
    return np.array(cuts[::-1], dtype=np.int64)


RESULTS = [("start", LongType(), pa.int64()), ("length", LongType(), pa.int64()), ("doc_tokens", LongType(), pa.int64()),
           ("sequence_id", LongType(), pa.int64()), ("offset", LongType(), pa.int64()), ("ids", BinaryType(), pa.binary())]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: ``id_col``, ``start`` and ``length`` in its document's ids, the ids themselves (little-endian
    unsigned 32-bit), ``doc_tokens``, and the ``sequence_id`` and ``offset`` where it was placed.

    Each task packs its own rows in the order it reads them, in blocks of bounded size and without a shuffle; a repeated
    task makes the same sequences. ``sequence_id`` holds the task's partition in its upper bits.
    """
    source = docs.select(f"`{id_col}`", f"`{text_col}`")
    schema = StructType([StructField(id_col, source.schema[0].dataType), *[StructField(n, t) for n, t, _ in RESULTS]])

    def placed(ids: pa.Array, coded: list[bytes], own: PieceTokenizer, first: int) -> tuple[pa.RecordBatch, int]:
        end = np.array([end_id], dtype="<u4").tobytes()
        flat = np.frombuffer(end.join(coded) + end, dtype="<u4")
        ends = np.cumsum([len(c) // 4 + 1 for c in coded])
        starts = np.concatenate([[0], ends[:-1]])
        cuts = best_cuts(*cut_places(ends, np.flatnonzero(own.sentence_end[np.minimum(flat, len(own.sentence_end) - 1)]) + 1))
        begins = np.union1d(starts, np.concatenate([[0], cuts[:-1]]))
        stops = np.append(begins[1:], len(flat))
        doc = np.searchsorted(ends, begins, side="right")
        seq = np.searchsorted(cuts, begins, side="right")
        seq_start = np.concatenate([[0], cuts[:-1]])[seq]
        raw = memoryview(flat).cast("B")
        arrays = [ids.take(pa.array(doc)), pa.array(begins - starts[doc]), pa.array(stops - begins), pa.array((ends - starts)[doc]),
                  pa.array(seq + first), pa.array(begins - seq_start),
                  pa.array([raw[4 * a:4 * b].tobytes() for a, b in zip(begins.tolist(), stops.tolist(), strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=[id_col, *[n for n, _, _ in RESULTS]]), first + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_tokenizer(tokenizer)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            coded, size, begin = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                ids = own.encode(text.as_py())
                coded.append(ids)
                size += len(ids) // 4 + 1
                if size >= BLOCK_IDS or i == batch.num_rows - 1:
                    out, first = placed(batch.column(0).slice(begin, len(coded)), coded, own, first)
                    yield out
                    coded, size, begin = [], 0, i + 1

    return source.mapInArrow(run, schema)
