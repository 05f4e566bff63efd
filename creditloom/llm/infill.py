"""Fill-in-the-middle transformation of documents.

A text is cut in two places into prefix, middle and suffix, which are put together again in another order between
sentinels: ``psm`` gives ``<P>prefix<S>suffix<M>middle``, ``spm`` gives ``<S>suffix<P>prefix<M>middle``, ``plain`` is the
text itself. Places and form come from a hash of seed and id, so every run gives the same result.

Places are counted in units: tokens (runs of ASCII letters, else single code points) or code points. Texts are handled as
UTF-8. A sparse exception index holds only the multibyte characters, by position, with the excess bytes up to each; a
binary search in it converts byte cuts to code points and back, and between two entries the conversion is a subtraction.
A text in ASCII has an empty index.

Defined results: a null or empty text is ``plain`` with an empty output. A text that holds a sentinel is ``plain``. A null
id counts as an empty one. Repeated rows get equal results. Extra columns stay; columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
PLAIN_FROM = 90  # of 100
SPM_BELOW = 20  # of 100
ROWS = 256  # rows that leave a task's worker at once
RESULTS = (("n", LongType(), pa.int64()), ("form", StringType(), pa.string()), ("prefix_chars", LongType(), pa.int64()),
           ("middle_chars", LongType(), pa.int64()), ("output", StringType(), pa.string()))


class ExceptionIndex:
    """The multibyte characters of a text in UTF-8: first byte, code point place, and excess bytes up to and with each."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(excess)])
        self.places = self.bytes - self.excess[:-1]

    def to_chars(self, cut: int) -> int:
        """Code points before a byte cut, which must not lie inside a character."""
        return int(cut - self.excess[np.searchsorted(self.bytes, cut)])

    def to_bytes(self, cut: int) -> int:
        """Bytes before a code point cut."""
        return int(cut + self.excess[np.searchsorted(self.places, cut)])


def token_starts(data: np.ndarray) -> np.ndarray:
    """First byte of every token: a run of ASCII letters, or any other character."""
    letter = ((data | 32) - np.uint8(97)) < 26
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def draws(seed: int, key: str) -> tuple[int, ...]:
    """Four integers of 32 bits from seed and id."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16])


def transformed(raw: bytes, key: str, seed: int = SEED, unit: str = "token") -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (None if plain), and the output of one text in UTF-8."""
    data = np.frombuffer(raw, np.uint8)
    index = ExceptionIndex(data)
    starts = token_starts(data) if unit == "token" else None
    n = len(starts) if unit == "token" else index.to_chars(len(raw))
    h1, h2, h3, h4 = draws(seed, key)
    if not raw or h3 % 100 >= PLAIN_FROM or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    if unit == "token":
        a, b = (int(starts[c]) if c < n else len(raw) for c in cuts)
        first, last = index.to_chars(a), index.to_chars(b)
    else:
        first, last = cuts
        a, b = index.to_bytes(first), index.to_bytes(last)
    if h4 % 100 < SPM_BELOW:
        return n, "spm", first, last - first, b"".join((SUFFIX, raw[b:], PREFIX, raw[:a], MIDDLE, raw[a:b]))
    return n, "psm", first, last - first, b"".join((PREFIX, raw[:a], SUFFIX, raw[b:], MIDDLE, raw[a:b]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, unit: str = "token") -> DataFrame:
    """The rows with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; one pass, no shuffle."""
    if unit not in ("token", "char"):
        raise ValueError("unit must be token or char")
    kept = [f for f in docs.schema.fields if f.name not in {r[0] for r in RESULTS}]
    names = [f.name for f in kept]
    schema = StructType([*kept, *[StructField(name, kind) for name, kind, _ in RESULTS]])
    rows = docs.select(*[f"`{n}`" for n in names], F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = [transformed(text.as_buffer().to_pybytes(), key.as_py(), seed, unit)
                     for key, text in zip(batch.column(len(names)), batch.column(len(names) + 1), strict=True)]
            columns = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*found, strict=True), RESULTS, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], *columns], names=[*names, *[r[0] for r in RESULTS]])

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))).when(
        form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(output)
