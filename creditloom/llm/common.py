"""What the corpus operators share: reading tables, scratch storage and plain column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: ASCII white space, as the contracts' word pattern excludes it.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def storage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Without one only a local master gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{storage_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to shared storage and read back: later steps neither recompute them nor depend on their executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z, nothing else changes."""
    return F.translate(text, UPPER, LOWER)


class WordHashes(dict):
    """64-bit hashes of words, remembered while they are at most ``limit``."""

    limit = 50_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def words_lower(text: str) -> list[bytes]:
    """The words of a text: A-Z lowered, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def connected(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` for every node of the edges ``u, v``: the smallest node it is connected with.

    Alternates the large-star and small-star steps until the edges no longer change. Every step is a pre-aggregated
    minimum and a plain join; each round is written to shared storage, so lineage stays short.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), f"{name}-edges")
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Least and most slots of a bit map that tells keys apart which surely miss a set: 128 KB to 8 MB. Beyond some 30 million keys
#: the map fills up, which lets more rows pass and loses none.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def key_bits(keys: DataFrame, *columns: str, each: int = 8) -> np.ndarray:
    """A bit map in which the slot of every key is set, of ``each`` slots a key or up to twice as many; one other row in ``each`` passes at
    most. ``keys`` is a stored table; slots are put together by a pre-aggregated ``bit_or``."""
    slots = min(max(LEAST_BITS, 1 << (each * keys.count()).bit_length()), MOST_BITS)
    slot = keys.select(F.pmod(F.xxhash64(*columns), F.lit(slots)).alias("slot"))
    word = slot.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    parts = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(slots // 64, np.int64)
    words[parts["word"].to_numpy()] = parts["bits"].to_numpy()
    return words.astype("<i8").view(np.uint8)


def has_bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def passing(rows: DataFrame, bits: np.ndarray, columns: list[str], wanted: bool) -> DataFrame:
    """The rows whose key the bit map may hold, or those whose key it surely misses. A key with a null first column is missed."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    name = "_slot"
    while name in rows.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = has_bit(shared.value, batch.column(batch.num_columns - 1).to_numpy()) == wanted
            out = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(out.columns[:-1], names=out.schema.names[:-1])

    first = F.col(f"`{columns[0]}`")
    known = rows.where(first.isNotNull()).withColumn(name, F.pmod(F.xxhash64(*columns), F.lit(8 * len(bits)))).mapInArrow(run, rows.schema)
    return known if wanted else known.unionByName(rows.where(first.isNull()))


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    v = np.ascontiguousarray(values, "<u8")
    return zstandard.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def bounds(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in sorted keys."""
    return np.searchsorted(keys >> np.uint64(32), (np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))


def squeezed(rows: DataFrame, name: str = "packed") -> DataFrame:
    """Rows whose last column, a text, is replaced by ``name``: its UTF-8 bytes compressed one by one."""
    fields = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = pa.array([press.compress(t.as_buffer()) for t in batch.columns[-1]], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*[f.name for f in fields], name])

    return rows.mapInArrow(run, StructType([*fields, StructField(name, BinaryType())]))
