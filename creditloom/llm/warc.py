"""WARC archives with dictionary-compressed records.

Every task writes archives of bounded size. An archive begins with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from the archive's own first records; then each record is a frame of its own, compressed
with that dictionary. Records with an equal payload of at least ``min_bytes`` bytes are written once: the smallest id
is the ``response``, the others are ``revisit`` records without a block that refer to it.

An archive is written under a name that holds the task attempt and is listed in the manifest only when complete. The
manifest is kept on shared storage, so readers never see the archives of an attempt that was lost.

Defined results: a null payload is empty; a null or empty address becomes ``urn:page:<id>``; a null id stays null and is
never a smallest id unless its group has no other. Rows that repeat an id are written each. Extra columns are ignored.
An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import scratch, stored

MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20  # of records before compression
SAMPLE_BYTES = 1 << 20  # of an archive's first records: what its dictionary is built from
DICTIONARY_BYTES = 32 << 10
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def marked(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to``; the last is null for responses.

    Equal payloads meet by digest. The smallest id comes from a pre-aggregated grouping, and the rows join only the
    groups of two and more, a plain join that adaptive execution splits where one payload is very common.
    """
    rows = pages.select(
        F.col("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    firsts = (
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    return rows.join(firsts, "payload_digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    own = f"urn:page:{'' if page_id is None else page_id}"
    heads = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else own}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Payload-Length: {size}",
    ]
    if refers_to is None:
        block = HTTP % len(payload) + payload
    else:
        heads += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = b""
    heads.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *heads, "", ""]).encode() + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; where these are too few or too alike to train on, their bytes themselves."""
    sample, size = [], 0
    for r in records:
        sample.append(r[: SAMPLE_BYTES - size])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    if len(sample) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _write(records: list[bytes], folder: str, name: str) -> str:
    words = _dictionary(records)
    raw = words.as_bytes()
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=words)
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        for r in records:
            out.write(squeeze.compress(r))
    return f"{folder}/{name}"


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 100) -> DataFrame:
    """Writes all pages and returns the stored manifest: ``archive`` (path), ``n_records``, ``raw_bytes``."""
    folder = folder or scratch(pages.sparkSession, "warc")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        records: list[bytes] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
            return pa.RecordBatch.from_pydict({"archive": [_write(records, folder, name)], "n_records": [len(records)], "raw_bytes": [size]})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, n, digest, refers_to = (c[i].as_py() for c in batch.columns)
                record = _record(page_id, url, payload, n, digest, refers_to)
                if records and size + len(record) > ARCHIVE_BYTES:
                    yield flush()
                    records, size, made = [], 0, made + 1
                records.append(record)
                size += len(record)
        if records:
            yield flush()

    return stored(marked(pages, min_bytes).select(*columns).mapInArrow(run, "archive string, n_records long, raw_bytes long"), "warc-manifest")


def _read(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    files, path = pafs.FileSystem.from_uri(path)
    with files.open_input_stream(path, compression=None) as raw:
        magic, n = struct.unpack("<II", raw.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path}: no dictionary frame")
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw.read(n)))
        with io.BufferedReader(unpack.stream_reader(raw, read_across_frames=True), 1 << 20) as lines:
            while line := lines.readline():
                if line != b"WARC/1.1\r\n":
                    raise ValueError(f"{path}: not a record: {line[:40]!r}")
                heads = {}
                while (line := lines.readline()) != b"\r\n":
                    key, _, value = line.decode().rstrip("\r\n").partition(": ")
                    heads[key] = value
                block = lines.read(int(heads["Content-Length"]))
                if lines.read(4) != b"\r\n\r\n":
                    raise ValueError(f"{path}: record without an end")
                yield heads, block


def _id(urn: str | None) -> int | None:
    tail = urn[len("<urn:page:"):-1] if urn else ""
    return int(tail) if tail else None


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the listed archives: ``page_id, url, record_type, refers_to, payload`` (null for revisits),
    ``payload_bytes, payload_digest``. A response whose payload does not fit its digest raises."""

    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for heads, block in _read(path):
                    kind, digest = heads["WARC-Type"], heads["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload, length = None, int(heads["Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        length = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: payload of {heads['WARC-Record-ID']} does not fit its digest")
                    rows.append((_id(heads["WARC-Record-ID"]), heads["WARC-Target-URI"], kind, _id(heads.get("WARC-Refers-To")), payload, length, digest))
                    size += length
                    if len(rows) >= 1000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return manifest.select("archive").repartition("archive").mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")
