"""Near-duplicate groups by an LSH forest over MinHash signatures.

A text's set is its distinct two-word shingles (all its words if there are fewer). Texts with equal sets are one node. A node
has a signature of ``HASHES`` MinHash values, 16 bits each. A tree of the forest is an order of the signature: tree t starts at
value ``t * FIRST`` and goes around, so the first ``FIRST`` levels of different trees share no value. In the sorted order
of a tree, nodes with a long common prefix stand together; a region is what shares one prefix.

The depth adapts to each region. It starts at ``FIRST`` values, where two sets with a similarity of 0.8 share a region of
one of the 32 trees but for one case in ten million. A region of at most ``REGION`` nodes is searched there: its nodes
meet those they have the longest common prefixes with, and a pair is a candidate if its keys agree in ``AGREE`` of the
``KEY`` values of the tree, their signatures in ``LIKELY`` values, and the sizes allow the similarity. A larger region is linked with one of its
own nodes, its pivot, and then falls apart into regions two values deeper; sizes and pivots are pre-aggregated, so no task sees a large region as a group.

Candidates are confirmed on the full sets. A group of thousands of copies is never expanded into its pairs: first every node
is confirmed against the pivot it meets in most trees, and the links form components; then, in regions of several components, against the
hub it meets in most trees, the node of a region whose keys most others share; then all candidates between different components. The task that
searches a region confirms them, the likeliest first, and hands on only links that join components: no more than it has nodes, however many of them are
alike. Inside a component nothing is compared.

At last the nodes of regions that are larger than ``REGION`` and still hold several components are joined exactly: two linked sets share one of
the rarest shingles of each (a fifth of them and one more), so whatever deeper regions missed is found by these lists, between components only.

Words and shingles are 64-bit hashes.

Defined results: a null or empty text has an empty set and is linked with nothing. Rows that repeat an id each have their
own text's set; equal ones are one node. A row without id is linked with nothing, has no component and is kept. Extra
columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from creditloom.llm.common import connected, key_bits, passing, squeezed, stored

SHARE = 80  # of 100
HASHES = 128
FIRST = 4
TREES = HASHES // FIRST
KEY = 16
STEP = 2
AGREE = 10
LIKELY = 80  # of HASHES; a pair of similarity 0.8 has less in one of a million cases
REGION = 1024
ROWS = 256
SLOTS = 1 << 18  # of shingles whose numbers of nodes are counted together
HELD = 1 << 25  # bytes of regions or of sets that a task holds, unless one region or one pair has more
PIECE = 1 << 20  # bytes of a text hashed at once, up to the end of a word
_FACTOR, _MIX, _BASE = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MULTIPLIERS = np.array([xxhash.xxh32_intdigest(b"forest", i) | 1 for i in range(HASHES)], np.uint32)[:, None]
#: A random number for every byte, the same for both cases of an ASCII letter; 0 marks white space.
_LETTERS = np.array([0 if i in b" \t\n\v\f\r" else xxhash.xxh64_intdigest(bytes([i]).lower()) | 1 for i in range(256)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _words_of(data: np.ndarray) -> np.ndarray:
    """A hash of each word: the numbers of its bytes times powers of their places."""
    letters = _LETTERS[data]
    at = np.flatnonzero(letters)
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    length = np.diff(np.append(first, len(at)))
    place = at - np.repeat(at[first], length)
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(length.max()), _BASE, np.uint64), dtype=np.uint64)])
    return _mixed(np.add.reduceat(letters[at] * powers[place], first) + length.astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in UTF-8, alike for both cases of A-Z."""
    data = np.frombuffer(text, np.uint8)
    out, begin = [], 0
    while len(data) - begin > PIECE:
        gaps = np.flatnonzero(_LETTERS[data[begin + PIECE:begin + 2 * PIECE]] == 0)
        end = begin + PIECE
        while not len(gaps) and end < len(data):
            end += PIECE
            gaps = np.flatnonzero(_LETTERS[data[end:end + PIECE]] == 0)
        if not len(gaps):
            break
        out.append(_words_of(data[begin:end + int(gaps[0])]))
        begin = end + int(gaps[0])
    return np.concatenate([*out, _words_of(data[begin:])])


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the two-word shingles of a text in UTF-8; of a single word its hash."""
    h = word_hashes(text)
    pairs = _mixed(h[:-1] * _FACTOR + h[1:]) if len(h) > 1 else h
    pairs.sort()
    return pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs


def signature(own: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty: the low half of the least product of its hashes' upper halves with each multiplier."""
    upper = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(upper), 1024):
        np.minimum(least, (upper[None, at:at + 1024] * _MULTIPLIERS).min(1), out=least)
    return least.astype(np.uint16)


def _signed(keyed: DataFrame) -> DataFrame:
    """``id, n, s1, s2, sig`` per row: size and digest of its set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            sizes, first, second, sigs = [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_buffer().to_pybytes())
                d = np.frombuffer(xxhash.xxh128_digest(own.tobytes()), np.int64)
                sizes.append(len(own))
                first.append(int(d[0]))
                second.append(int(d[1]))
                sigs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(sigs, pa.binary())],
                names=["id", "n", "s1", "s2", "sig"])

    return keyed.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "id long, n long, s1 long, s2 long, sig binary")


def _comparable(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * SHARE


def _trees(nodes: DataFrame) -> DataFrame:
    """``id, n, tree, key`` for every node and tree."""
    around = F.concat("sig", "sig")
    return nodes.select("id", "n", around.alias("around"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "id", "n", "tree", F.expr(f"substring(around, tree * {2 * FIRST} + 1, {2 * KEY})").alias("key"))


def _regions(rows: DataFrame, depth: int) -> DataFrame:
    """The rows by their region ``h`` of this depth."""
    return rows.withColumn("h", F.xxhash64("tree", F.expr(f"substring(key, 1, {2 * depth})")))


def _pivots(rows: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of a node and the pivot of its region, once for each tree. The pivot is the node whose hash is smallest, alike in all trees."""
    pivot = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("id").alias("by"), F.col("id").alias("id"), F.col("n").alias("n"))).alias("p"))
    return rows.join(pivot, "h").where((F.col("id") != F.col("p.id")) & _comparable(F.col("n"), F.col("p.n"))).select(
        F.col("p.id").alias("u"), F.col("id").alias("v"), "tree")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose signatures agree in ``LIKELY`` values. ``nodes``: id, sig."""
    both = pairs.select("u", "v").join(nodes.select(F.col("id").alias("v"), F.col("sig").alias("b")), "v").join(
        nodes.select(F.col("id").alias("u"), F.col("sig").alias("a")), "u").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, HASHES) for c in batch.columns[2:])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array((a == b).sum(1) >= LIKELY))

    return both.mapInArrow(run, "u long, v long")


@lru_cache(maxsize=64)
def _set_of(packed: bytes) -> np.ndarray:
    return shingle_set(zstandard.decompress(packed))


class _Sets(OrderedDict):
    """Sets of nodes, the last used ones up to ``HELD`` bytes."""

    size = 0

    def of(self, node: int, packed: pa.BinaryScalar) -> np.ndarray:
        if node in self:
            self.move_to_end(node)
            return self[node]
        own = self[node] = shingle_set(zstandard.decompress(packed.as_py()))
        self.size += own.nbytes
        while self.size > HELD and len(self) > 2:
            self.size -= self.popitem(last=False)[1].nbytes
        return own


def _reach(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= SHARE * (len(a) + len(b) - shared)


def _confirmed(pairs: DataFrame, nodes: DataFrame | None, texts: DataFrame, name: str) -> DataFrame:
    """The pairs ``u, v`` whose full sets reach the similarity, with ``nodes`` only of those whose signatures are alike. ``texts``: id, packed,
    one row per node."""
    pairs = stored(pairs.select("u", "v") if nodes is None else _alike(pairs, nodes), name)
    both = pairs.join(texts.select(F.col("id").alias("v"), F.col("packed").alias("b")), "v").join(
        texts.select(F.col("id").alias("u"), F.col("packed").alias("a")), "u").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            keep = [_reach(_set_of(a.as_py()), _set_of(b.as_py())) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(run, "u long, v long"), f"{name}-links")


def _neighbours(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``a, b`` of candidate pairs of different components in rows by region, and in how many values their signatures agree.

    A pair that meets in several trees counts in the first of those where its region is searched at depth ``FIRST``; ``small`` has a bit for each such tree."""
    h, n, comp, tree, small, depth = (table[c].to_numpy() for c in ("h", "n", "component", "tree", "small", "depth"))
    sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
    found, left = [], np.arange(len(h))
    for step in range(1, REGION):
        left = left[left + step < len(h)]
        left = left[h[left] == h[left + step]]
        if not len(left):
            break
        a, b = left, left + step
        near = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * SHARE)
        a, b = a[near], b[near]
        same = sigs[a] == sigs[b]
        met = same.sum(1)
        likely = met >= LIKELY
        a, b, met = a[likely], b[likely], met[likely]
        if not len(a):
            continue
        parts = same[likely].reshape(-1, TREES, FIRST).sum(2)
        agree = sum(np.roll(parts, -i, 1) for i in range(KEY // FIRST)) >= AGREE
        shared = agree & (parts == FIRST) & ((small[a][:, None] >> np.arange(TREES) & 1) == 1)
        first = np.where(shared.any(1), shared.argmax(1), -1)
        own = np.where(depth[a] == FIRST, first == tree[a], (first < 0) & agree[np.arange(len(a)), tree[a]])
        found.append((a[own], b[own], met[own]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _linked(table: pa.Table) -> pa.RecordBatch:
    """Links ``u, v`` that join the components of rows by region as far as their candidates' full sets reach the similarity. What is joined already is not compared."""
    a, b, met = _neighbours(table)
    ids, packed = table["id"].to_numpy(), table["packed"]
    comp = np.unique(table["component"].to_numpy(), return_inverse=True)[1].tolist()
    root = list(range(len(comp)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sets, links = _Sets(), []
    order = np.lexsort((b, a, -met))
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        cx, cy = top(comp[x]), top(comp[y])
        if cx != cy and _reach(sets.of(int(ids[x]), packed[x]), sets.of(int(ids[y]), packed[y])):
            root[cx] = cy
            links.append((int(ids[x]), int(ids[y])))
    return pa.RecordBatch.from_arrays([pa.array([f(p) for p in links], pa.int64()) for f in (min, max)], names=["u", "v"])


def _by_region(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """What ``work`` makes of whole regions ``h``, several at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * REGION and sum(b.nbytes for b in held) < HELD:
                continue
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            whole = int(np.flatnonzero(h == h[-1])[0])  # the last region may go on
            if whole:
                yield work(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition("h").sortWithinPartitions("h", "key").mapInArrow(run, schema)


def _met(small: DataFrame) -> DataFrame:
    """The rows of regions of at most ``REGION`` nodes that are in a candidate pair of their region."""

    def run(table: pa.Table) -> pa.RecordBatch:
        a, b, _ = _neighbours(table)
        return table.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()[0] if len(a) else empty

    rows = small.select("h", "id", "n", "key", "component", "sig", "tree", "small", "depth")
    empty = pa.RecordBatch.from_pylist([], to_arrow_schema(rows.schema))
    return _by_region(rows, run, rows.schema)


def _open(rows: DataFrame, depth: int) -> DataFrame:
    """The rows of the regions of this depth that hold several components, by region ``h`` with its size ``c``."""
    rows = _regions(rows, depth)
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return rows.join(sizes.select("h", "c"), "h")


def _with_components(forest: DataFrame, comps: DataFrame) -> DataFrame:
    joined = forest.join(comps, F.col("id") == F.col("node"), "left")
    return joined.select("id", "n", "tree", "key", F.coalesce("component", "id").alias("component"))


def _hubs(forest: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs ``u, v, met`` of the hub of a region and a node of another component, with the number of trees in which they met.

    The hub is the node that shares its whole keys with most nodes, over all trees: copies with changes of their own have little in common with
    each other, but most keys of the text they stem from."""
    rows = stored(_open(_with_components(forest, comps), FIRST), "forest-open")
    sharing = rows.groupBy("h", "key").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    score = rows.join(sharing, ["h", "key"]).groupBy("id").agg(F.sum("others").alias("score"))
    hub = rows.join(score, "id").groupBy("h").agg(F.max(F.struct("score", "id", "n", "component")).alias("hub"))
    met = rows.join(hub, "h").where((F.col("component") != F.col("hub.component")) & _comparable(F.col("n"), F.col("hub.n")))
    return met.groupBy(F.col("hub.id").alias("u"), F.col("id").alias("v")).agg(F.count(F.lit(1)).alias("met"))


def _slots(own: np.ndarray) -> np.ndarray:
    return (own % np.uint64(SLOTS)).astype(np.int64)


def _by_rarest(forest: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs ``u, v`` of different components that can be linked, of the nodes in regions larger than ``REGION`` with several components.

    Shingles are ordered by the number of these nodes that have one of their slot, of ``SLOTS`` slots by hash: any order that is the same for all sets finds
    all links. Linked sets share one of the first n // 5 + 1 of each, and behind the first one
    shared there must be enough left in both. In a list one end of every pair lies outside the list's largest component, so
    a large component costs its members times the others, not its pairs."""
    rest = _open(_with_components(forest, comps), FIRST).where(F.col("c") > REGION).select("id", "n", "component").distinct()
    rest = stored(rest, "forest-large")
    if rest.isEmpty():
        return rest.selectExpr("id AS u", "id AS v")
    sets = stored(rest.join(texts, "id").select("id", "n", "component", "packed"), "forest-sets")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                np.add.at(total, _slots(shingle_set(zstandard.decompress(packed.as_py()))), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "c"])

    parts = sets.select("packed").mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[parts["slot"].to_numpy()] = parts["c"].to_numpy()
    shared = forest.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            own = shingle_set(zstandard.decompress(batch.column(3)[0].as_py()))
            own = own[np.lexsort((own, shared.value[_slots(own)]))[:len(own) * (100 - SHARE) // 100 + 1]].view(np.int64)
            same = [pa.array(np.full(len(own), c[0].as_py(), np.int64)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*same, pa.array(own), pa.array(np.arange(1, len(own) + 1))], names=["id", "n", "component", "h", "place"])

    lists = stored(sets.mapInArrow(rarest, "id long, n long, component long, h long, place long"), "forest-rarest")
    main = lists.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(
        F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("c", "component")).alias("main")).where("components > 1").select("h", "main")
    lists = stored(lists.join(main, "h"), "forest-lists")
    pairs = lists.where("component <> main").alias("a").join(lists.alias("b"), "h").where("a.component <> b.component").where(
        _comparable(F.col("a.n"), F.col("b.n"))).where(f"(1 + least(a.n - a.place, b.n - b.place)) * {100 + SHARE} >= {SHARE} * (a.n + b.n)")
    return pairs.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _across(forest: DataFrame, nodes: DataFrame, comps: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``u, v`` between components in regions of at most ``REGION`` nodes, and candidates ``u, v, cu, cv, met`` with pivots of larger ones.

    A region's task confirms its candidates itself, so what leaves it is less than its rows, however many of its texts are alike."""
    rows, found, stars = _with_components(forest, comps), None, None
    searched = F.bit_or(F.when(F.col("c") <= REGION, F.expr("shiftleft(1L, tree)")).otherwise(F.lit(0))).over(Window.partitionBy("id"))
    for depth in range(FIRST, KEY + 1, STEP):
        rows = _open(rows, depth)
        rows = stored(rows.join(nodes, "id").withColumn("small", searched) if depth == FIRST else rows, f"forest-depth{depth}")
        own = rows.where(F.col("c") <= REGION).withColumn("depth", F.lit(depth))
        found = own if found is None else found.unionByName(own)
        rows = rows.where(F.col("c") > REGION)
        if rows.isEmpty():
            break
        pairs = _pivots(rows).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        stars = pairs if stars is None else stars.unionByName(pairs)
        rows = rows.drop("h", "c")
    links = _by_region(stored(_met(found), "forest-met").join(texts, "id"), _linked, "u long, v long")
    stars = found.selectExpr("id AS u", "id AS v").limit(0) if stars is None else stars
    return stored(links, "forest-regions"), _between(stars.groupBy("u", "v").agg(F.count(F.lit(1)).alias("met")), comps)


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Only the pairs ``u, v, met`` that lie in two components, ``cu`` and ``cv``."""
    for end in ("u", "v"):
        own = comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.drop(f"c{end}").join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("cu <> cv")


def _joined(comps: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components after more links; ``links`` is stored."""
    return comps if links.isEmpty() else connected(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links), name)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row."""
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    made = stored(_signed(keyed), "forest-signed")
    same = made.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    named = stored(made.select("id", "n", "s1", "s2").join(same, ["s1", "s2"], "left").select(
        "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id")).alias("rep")), "forest-nodes")
    nodes = made.where("n > 0 and id is not null").join(same, ["s1", "s2"], "left_semi").groupBy("s1", "s2").agg(
        F.min(F.struct("id", "n", "sig")).alias("x")).select("x.*")
    regions = _regions(_trees(nodes), FIRST)
    shared = regions.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    forest = stored(regions.join(shared, "h"), "forest-trees")
    ends = stored(forest.select("id").distinct(), "forest-ends")
    nodes = stored(nodes.join(ends, "id", "left_semi").select("id", "sig"), "forest-signatures")
    texts = passing(keyed.where("text is not null"), key_bits(ends, "id"), ["id"], True).join(ends, "id", "left_semi")
    texts = stored(squeezed(texts.groupBy("id").agg(F.min("text").alias("text")).select("id", "text")), "forest-texts")

    def best(of: DataFrame, by: list[str]) -> DataFrame:
        return of.groupBy(*by).agg(F.max(F.struct("met", F.col("u").alias("x"), F.col("v").alias("y"))).alias("m")).select(
            F.col("m.x").alias("u"), F.col("m.y").alias("v"))

    stars = _pivots(forest).groupBy("u", "v").agg(F.count(F.lit(1)).alias("met"))
    comps = connected(_confirmed(best(stars, ["v"]), nodes, texts, "forest-stars"), "forest-first")
    forest = forest.drop("h")
    comps = _joined(comps, _confirmed(best(_hubs(forest, comps), ["v"]), nodes, texts, "forest-hubs"), "forest-around")
    links, stars = _across(forest, nodes, comps, texts)
    comps = _joined(comps, links, "forest-second")
    comps = _joined(comps, _confirmed(_between(stars, comps), nodes, texts, "forest-rest"), "forest-third")
    comps = _joined(comps, _confirmed(_by_rarest(forest, comps, texts), None, texts, "forest-exact"), "forest-all")
    out = named.join(comps, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
