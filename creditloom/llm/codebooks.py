"""Compression of vectors to codes by Lloyd's rounds over two trees.

Vectors become integers and are cut into equal parts; each part position has a codebook. The codebook starts as that part
of the vectors with the smallest ids, and each round replaces an entry by the mean of the parts nearest to it.

The nearest entries are found for many parts at once. Vectors are kept in blocks; in a block each part position has a tree
over the parts, whose nodes are halves of their parent along its widest component and know the box around their
parts, their number and their sum. The entries of a codebook form a tree of the same kind. Both are descended together:
of a pair of nodes, the distance between the boxes is a lower bound and the distance of their far corners an upper one. An entry
node that is farther at best than another at worst is dropped. Where one entry is left, the whole node is
assigned by its cached sum; at leaves where several are left, integer distances decide. All bounds are integers and
only strictly farther entries are dropped, so ties go to the lower index exactly.

A round reads the blocks once and sends one small sum per entry component out of each task. Blocks are written to shared
storage; what reaches the driver is the codebooks, whose size depends on the length of a vector alone.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped. The vectors' length is that
of the vector with the smallest id; vectors of another length, all vectors if ``parts`` does not divide that length, and vectors
with a component of ``LARGEST`` or more after scaling, for which sums could leave 64 bits, stay as rows with null code and errors and
take no part. Rows without id get codes but start no entry. Rows that repeat an id each count; equal ids are ordered by
their vectors. With fewer vectors than entries there are as many entries as vectors; repeated entries leave the later one unused. An empty
table gives no rows. Columns other than id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from creditloom.llm.common import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 28
LEAF = 32
BLOCK_BYTES = 4 << 20


def halves(n: int, leaf: int) -> list[np.ndarray]:
    """Edges of the nodes of each level: every node is cut in the middle until none holds more than ``leaf`` rows."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > leaf:
        e = levels[-1]
        cut = np.empty(2 * len(e) - 1, np.int64)
        cut[::2], cut[1::2] = e, (e[:-1] + e[1:]) // 2
        levels.append(cut)
    return levels


def tree_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of the rows in which every node of ``halves`` is a half of its parent along the parent's widest component."""
    order = np.arange(len(points))
    for edges, below in zip(levels := halves(len(points), leaf), levels[1:]):
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            own = points[order[a:b]]
            widest = int(np.argmax(own.max(0) - own.min(0)))
            order[a:b] = order[a:b][np.argpartition(own[:, widest], int(below[2 * i + 1]) - a)]
    return order


@dataclass
class PointTree:
    """Parts in tree order with the box and the sum of every node, by level."""

    points: np.ndarray
    edges: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @classmethod
    def over(cls, points: np.ndarray, leaf: int = LEAF) -> PointTree:
        edges = halves(len(points), leaf)
        low, high, sums = ([f.reduceat(points, edges[-1][:-1])] for f in (np.minimum, np.maximum, np.add))
        for _ in edges[1:]:
            for level, f in ((low, np.minimum), (high, np.maximum), (sums, np.add)):
                level.insert(0, f(level[0][::2], level[0][1::2]))
        return cls(points, edges, low, high, sums)


@dataclass
class EntryTree:
    """A tree over codebook entries; leaves hold one entry. ``entry`` is -1 at inner nodes."""

    low: np.ndarray
    high: np.ndarray
    children: np.ndarray
    entry: np.ndarray

    @classmethod
    def over(cls, book: np.ndarray) -> EntryTree:
        nodes: list[list] = []

        def grow(members: np.ndarray) -> int:
            own, at = book[members], len(nodes)
            nodes.append([own.min(0), own.max(0), (-1, -1), -1])
            if len(members) == 1:
                nodes[at][3] = int(members[0])
            else:
                widest = int(np.argmax(own.max(0) - own.min(0)))
                members = members[np.argsort(own[:, widest], kind="stable")]
                half = len(members) // 2
                nodes[at][2] = (grow(members[:half]), grow(members[half:]))
            return at

        grow(np.arange(len(book)))
        return cls(*(np.array(c) for c in zip(*nodes, strict=True)))


def _pruned(node: np.ndarray, entry: np.ndarray, low: np.ndarray, high: np.ndarray, tree: EntryTree) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may hold a nearest entry. Pairs come sorted by point node and stay so."""
    gap = np.maximum(np.maximum(tree.low[entry] - high[node], low[node] - tree.high[entry]), 0)
    far = np.maximum(tree.high[entry] - low[node], high[node] - tree.low[entry])
    least, most = (gap * gap).sum(1), (far * far).sum(1)
    begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    best = np.repeat(np.minimum.reduceat(most, begins), np.diff(np.append(begins, len(node))))
    keep = least <= best
    return node[keep], entry[keep]


def _opened(node: np.ndarray, entry: np.ndarray, tree: EntryTree) -> tuple[np.ndarray, np.ndarray]:
    """Inner entry nodes replaced by their children."""
    inner = tree.entry[entry] < 0
    size = 1 + inner.astype(np.int64)
    first = np.cumsum(size) - size
    out = np.repeat(entry, size)
    out[first[inner]] = tree.children[entry[inner], 0]
    out[first[inner] + 1] = tree.children[entry[inner], 1]
    return np.repeat(node, size), out


def nearest(points: PointTree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Index of the nearest entry for every point, numbers and sums by entry, and how many points were assigned by whole nodes."""
    tree = EntryTree.over(book)
    codes = np.zeros(len(points.points), np.uint8)
    counts, sums, whole = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64), 0
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level, edges in enumerate(points.edges):
        last = level == len(points.edges) - 1
        while True:
            node, entry = _pruned(*_opened(node, entry, tree), points.low[level], points.high[level], tree)
            if not last or not (tree.entry[entry] < 0).any():
                break
        left = np.bincount(node, minlength=len(edges) - 1)
        done = (left[node] == 1) & (tree.entry[entry] >= 0)
        for j, e in zip(node[done].tolist(), tree.entry[entry[done]].tolist(), strict=True):
            codes[edges[j]:edges[j + 1]] = e
        np.add.at(counts, tree.entry[entry[done]], np.diff(edges)[node[done]])
        np.add.at(sums, tree.entry[entry[done]], points.sums[level][node[done]])
        whole += int(np.diff(edges)[node[done]].sum())
        node, entry = node[~done], entry[~done]
        if last or not len(node):
            break
        begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.append(begins, len(node)))
        pick = np.concatenate([np.tile(np.arange(b, b + s), 2) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)])
        side = np.concatenate([np.repeat([0, 1], s) for s in sizes.tolist()])
        node, entry = 2 * node[pick] + side, entry[pick]
    if len(node):
        leaf = node[np.concatenate([[True], node[1:] != node[:-1]])]
        size = np.diff(edges)[leaf]
        row = np.repeat(edges[leaf] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        unsure = points.points[row]
        # Squared distances less the part's own square. Dropped entries are strictly farther, so they need no mask.
        codes[row] = own = ((book * book).sum(1) - 2 * (unsure @ book.T)).argmin(1)  # the first of equal ones
        counts += np.bincount(own, minlength=len(book))
        np.add.at(sums, own, unsure)
    return codes, counts, sums, whole


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def _blocks(rows: DataFrame, dims: int, parts: int, scale: int) -> DataFrame:
    """Rows ``id, vector, label`` as blocks: lists of ids and labels, and for the fit ones ``points`` in tree order by part with that order."""
    id_type, label_type = rows.schema["id"].dataType, rows.schema["label"].dataType
    schema = StructType([StructField("ids", ArrayType(id_type)), StructField("labels", ArrayType(label_type)), StructField("fit", BinaryType()),
                         StructField("points", BinaryType()), StructField("orders", BinaryType())])
    most = max(LEAF, BLOCK_BYTES // (8 * max(dims, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, most) for b in batches for i in range(0, b.num_rows, most)):
            vectors = batch.column(1)
            fit = np.zeros(batch.num_rows, bool)
            if dims and dims % parts == 0:
                fit = np.diff(vectors.offsets.to_numpy()) == dims
            flat = vectors.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims or 1)
            whole = _integers(flat, scale)
            small = (np.abs(whole) < LARGEST).all(1)
            fit[fit] = small
            whole = whole[small].astype(np.int32)
            points, orders = [], []
            for part in np.split(whole, parts, axis=1) if len(whole) else []:
                order = tree_order(part)
                points.append(part[order])
                orders.append(order.astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.concat_arrays([batch.column(i)])) for i in (0, 2)]
            binary = [pa.array([x], pa.binary()) for x in (np.packbits(fit).tobytes(), b"".join(p.tobytes() for p in points), b"".join(o.tobytes() for o in orders))]
            yield pa.RecordBatch.from_arrays([*lists, *binary], names=schema.names)

    return rows.select("id", "vector", "label").mapInArrow(run, schema)


def _trees(points: bytes, parts: int, width: int) -> list[PointTree]:
    flat = np.frombuffer(points, np.int32).astype(np.int64)
    return [PointTree.over(p.reshape(-1, width)) for p in np.split(flat, parts)] if len(flat) else []


def _next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for points in batch.column(0):
                for k, tree in enumerate(_trees(points.as_buffer().to_pybytes(), parts, width)):
                    _, c, s, _ = nearest(tree, books[k])
                    counts[k] += c
                    sums[k] += s
        used = counts > 0
        place = np.arange(books.size).reshape(books.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place[used].ravel()), pa.array(np.repeat(counts[used], width)), pa.array(sums[used].ravel())], names=["place", "n", "total"])

    rows = blocks.select("points").mapInArrow(run, "place long, n long, total long").groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy().ravel()
    for place, n, total in rows.collect():  # one row per codebook component
        out[place] = total // n
    return out.reshape(books.shape)


def fit(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after Lloyd's rounds."""
    for _ in range(rounds):
        books = _next_books(blocks, books)
    return books


def _coded(blocks: DataFrame, books: np.ndarray, schema: StructType) -> DataFrame:
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, fit, points, orders in zip(*batch.columns, strict=True):
                n = len(ids)
                mask = np.unpackbits(np.frombuffer(fit.as_buffer(), np.uint8))[:n].astype(bool)
                order = np.frombuffer(orders.as_buffer(), np.int32).reshape(parts, -1)
                codes, errors = np.zeros((int(mask.sum()), parts), np.uint8), np.zeros(int(mask.sum()), np.int64)
                for k, tree in enumerate(_trees(points.as_buffer().to_pybytes(), parts, width)):
                    own, _, _, _ = nearest(tree, books[k])
                    gap = tree.points - books[k][own]
                    codes[order[k], k] = own
                    errors[order[k]] += (gap * gap).sum(1)
                text, error = np.full(n, None, object), np.zeros(n, np.int64)
                text[mask] = [c.tobytes().hex() for c in codes]
                error[mask] = errors
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(text, pa.string()), pa.array(error, pa.int64(), mask=~mask)], names=schema.names)

    return blocks.mapInArrow(run, schema)


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``id_col, label_col, code, error, label_error, codebooks`` for every kept row; ``codebooks`` holds all final components."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256, as a code takes two hexadecimal digits")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.col(f"`{label_col}`").alias("label"))
    rows = rows.where(_finite(F.col("vector")))
    known = rows.where("id is not null")
    smallest = known.orderBy("id", "vector").limit(1).select(F.size("vector")).collect()
    dims = smallest[0][0] if smallest else 0
    usable = dims > 0 and dims % parts == 0
    starts = []
    if usable:
        within = F.forall("vector", lambda x: (F.floor(x.cast("double") * scale) < LARGEST) & (F.floor(x.cast("double") * scale) > -LARGEST))
        first = known.where((F.size("vector") == dims) & within).orderBy("id", "vector").limit(entries).select("vector").collect()
        starts = [r[0] for r in first]
    if not starts:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks", "string"))]
        return rows.select(F.col("id").alias(id_col), F.col("label").alias(label_col), *none)
    books = _integers(np.array(starts), scale).astype(np.int64).reshape(len(starts), parts, -1).transpose(1, 0, 2)
    blocks = stored(_blocks(rows, dims, parts, scale), "codes-blocks")
    books = fit(blocks, np.ascontiguousarray(books), rounds)
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("label", rows.schema["label"].dataType),
                         StructField("code", StringType()), StructField("error", LongType())])
    coded = stored(_coded(blocks, books, schema), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    text = ",".join(map(str, books.ravel().tolist()))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("same")), "left").select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", F.when(F.col("error").isNotNull(), F.col("label_error")).alias("label_error"),
        F.lit(text).alias("codebooks"))


def digest(codebooks: str) -> str:
    return hashlib.sha256(codebooks.encode()).hexdigest()
