"""BPE encoding and decoding of whole texts.

The merge loop keeps the ranks of all adjacent pairs in a segment tree. Its root names the leftmost pair of
lowest rank; a merge retires one position and changes at most two neighbouring ranks, each a logarithmic update,
until no mergeable pair is left.

Texts are split at single blanks. For a vocabulary whose words exclude white space such pieces never interact,
so the ids of a piece are computed once per worker and kept in a bounded cache; the ids of a text are the joined
ids of its pieces. The cache only saves time: a piece that is not in it is encoded anew.

Defined results: null and empty texts have no ids and decode to an empty text. Repeated rows give repeated rows.
Extra input columns stay; one that bears a result's name is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

NO_RANK = 1 << 60
CACHE_PIECES = 400_000
CACHE_PIECE_CHARS = 64
#: The code points that `\s` stands for in the tokenizer files.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class PieceCache(dict):
    """Ids of short pieces; when full, the older half goes."""

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                for old in list(islice(self, CACHE_PIECES // 2)):
                    del self[old]
            self[piece] = ids
        return ids

    def joined(self, pieces: list[str], encode: Callable[[str], bytes]) -> bytes:
        found = list(map(self.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    known = self.get(pieces[i])
                    found[i] = self.keep(pieces[i], encode(pieces[i])) if known is None else known
        return b"".join(found)


class PairTree:
    """Minimum segment tree over the ranks of adjacent pairs; ties go to the left."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        self.low = [NO_RANK] * size + ranks + [NO_RANK] * (size - len(ranks))
        low = self.low
        for i in range(size - 1, 0, -1):
            a, b = low[2 * i], low[2 * i + 1]
            low[i] = a if a <= b else b

    def put(self, at: int, rank: int) -> None:
        low = self.low
        i = at + self.size
        if low[i] == rank:
            return
        low[i] = rank
        i >>= 1
        while i:
            a, b = low[2 * i], low[2 * i + 1]
            best = a if a <= b else b
            if low[i] == best:
                return
            low[i] = best
            i >>= 1

    def leftmost_lowest(self) -> int:
        """Position of the leftmost pair with the lowest rank, or -1 if no pair can be merged."""
        low, i = self.low, 1
        rank = low[1]
        if rank == NO_RANK:
            return -1
        while i < self.size:
            i *= 2
            if low[i] != rank:
                i += 1
        return i - self.size


def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies use for each byte: printable ones stand for themselves,
    the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    spare = 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder for a tokenizer file whose words end in a suffix and exclude white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * tokens
        for word, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = word
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        self.white = regex.compile(f"[{WHITE}]+")
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache, self.word_cache = PieceCache(), PieceCache()

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges adjacent symbols, lowest rank first and leftmost first among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        pairs = self.pairs
        made = [pairs.get((symbols[i], symbols[i + 1])) for i in range(n - 1)]
        tree = PairTree([m[0] if m else NO_RANK for m in made])
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        while (i := tree.leftmost_lowest()) >= 0:
            j = after[i]
            symbols[i] = made[i][1]
            alive[j] = False
            k = after[j]
            after[i] = k
            if j < n - 1:
                tree.put(j, NO_RANK)
            if k < n:
                before[k] = i
                made[i] = pairs.get((symbols[i], symbols[k]))
                tree.put(i, made[i][0] if made[i] else NO_RANK)
            else:
                tree.put(i, NO_RANK)
            h = before[i]
            if h >= 0:
                made[h] = pairs.get((symbols[h], symbols[i]))
                tree.put(h, made[h][0] if made[h] else NO_RANK)
        return [s for s, on in zip(symbols, alive, strict=True) if on]

    def _word(self, word: str) -> bytes:
        ids = self.word_cache.get(word)
        if ids is None:
            letters = self.letters
            symbols = [letters[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            ids = self.word_cache.keep(word, array("I", self.merge([self.vocab[s] for s in symbols if s in self.vocab])).tobytes())
        return ids

    def _plain(self, text: str) -> bytes:
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        lowered = text.lower() if text.isascii() else "".join([c.lower() for c in text])
        return b"".join([self._word(w) for w in self.words.findall(lowered)])

    def piece(self, text: str) -> bytes:
        """Ids of a piece as little-endian 32-bit integers; strings of special tokens become their ids."""
        if self.apart is None or not self.apart.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [self._plain(text[at:m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode(self, text: str | None) -> bytes:
        return self.cache.joined(text.split(" "), self.piece) if text else b""

    def decode(self, ids: bytes) -> str:
        """The tokens joined by blanks, special ones included: what a tokenizer file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and ``decoded`` to every row.

    One pass over the rows without a shuffle. ``tokenizer`` is the path of a tokenizer file on every executor.
    """
    results = ("ids", "n_tokens", "decoded")
    kept = [f for f in docs.schema.fields if f.name not in results and f.name != text_col]
    schema = StructType([*kept, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, 256):  # results are larger than texts
                part = batch.slice(start, 256)
                ids = [own.encode(t.as_py()) for t in texts.slice(start, 256)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(names))], pa.array(ids, pa.binary()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.string())],
                    names=[*names, *results])

    return docs.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, schema)
