"""Boosted trees of MLlib's GBTClassifier, trained on binned rows held as arrays.

The model is the one MLlib trains: candidate thresholds from a sample of max(bins squared, 10,000) rows, variance as impurity, logistic
loss, the first tree on the labels and the others on the residuals, every row in every round. What differs is how a level is counted:
a row is one byte per feature in blocks of thousands of rows, and a task counts a block in a few vector operations for all nodes of the
level. A level is one job without a shuffle; what reaches the driver are sums per node, feature and bin, one set for each task, and there
are at most as many tasks as cores, whatever the input.

Class weights are one number per class, so a bin is counted per class. The binned rows are checkpointed; the margins of a round derive from
those of the round before, and every ``REBUILD`` rounds from the binned rows and all trees, which bounds what a lost executor repeats.
The result is written in MLlib's own layout and loaded as its model.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.session import shared_folder

BLOCK = 65_536  # rows of a block
PIECE = 2048  # rows of what is dealt over the tasks
REBUILD = 50
DIRECT = 64  # task results that the driver adds up by itself
PURE = 2.220446049250313e-16  # impurity below which MLlib does not split a node
NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
        "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


@dataclass
class Tree:
    """Nodes by heap place (children of i: 2i + 1, 2i + 2): split feature or -1, last bin that goes left, and the prediction times the tree's weight."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    stats: dict[int, tuple[float, float, float, int]] = field(default_factory=dict)  # weight, sum and square sum of the targets, rows
    gain: dict[int, float] = field(default_factory=dict)

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def bare(self) -> Tree:
        return Tree(self.feature, self.cut, self.value)


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int, total: float) -> np.ndarray:
    """Candidate thresholds of a feature: all midpoints of neighbouring values if they are few, else those nearest to equal weights.

    As in MLlib, zeros have what the other values leave of ``total``, the weight that a sample of this share should have.
    """
    values, weights = values[values != 0], weights[values != 0]
    zeros = total - weights.sum()
    if zeros > PURE * len(values) * 100:
        values, weights = np.append(values, 0.0), np.append(weights, zeros)
    distinct, place = np.unique(values, return_inverse=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) < bins:
        return middle
    counts = np.bincount(place, weights=weights)
    stride = total / bins
    out, current, target = [], counts[0], stride
    for i in range(1, len(counts)):
        previous, current = current, current + counts[i]
        if abs(previous - target) < abs(current - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _sample(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that MLlib draws for its thresholds with this seed, or all."""
    if share >= 1:
        return rows
    spark = rows.sparkSession
    drawn = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD().sample(False, share, drawn), rows._jdf.schema()), spark)


def _pieces(train: DataFrame, features: list[str], label: str, cuts: list[np.ndarray]) -> DataFrame:
    """``bins, positive``: the rows' bins (feature by feature, a byte each) and labels, up to ``PIECE`` rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            bins = b"".join(np.searchsorted(cut, batch.column(j).to_numpy(zero_copy_only=False)).astype(np.uint8).tobytes() for j, cut in enumerate(cuts))
            yes = (batch.column(len(cuts)).to_numpy(zero_copy_only=False) == 1).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([bins], pa.binary()), pa.array([yes], pa.binary())], names=["bins", "positive"])

    return train.select(*features, label).mapInArrow(run, "bins binary, positive binary")


def _places(bins: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """The heap place of every row after so many levels; rows in a leaf stay there."""
    n = bins.shape[1]
    flat, row, at = bins.reshape(-1), np.arange(n), np.zeros(n, np.int64)
    base = np.maximum(tree.feature, 0) * n
    step = (tree.feature >= 0).astype(np.int64)
    for _ in range(levels):
        right = flat[base[at] + row] > tree.cut[at]
        at += step[at] * (at + 1 + right)
    return at


def _blocks(pieces: RDD, width: int, trees: list[Tree], depth: int) -> RDD:
    """Blocks (bins, positive, margin) of whole tasks' rows, with the margins after ``trees``."""

    def made(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins = np.concatenate([np.frombuffer(r[0], np.uint8).reshape(width, -1) for r in held], axis=1)
        margin = np.zeros(bins.shape[1])
        for tree in trees:
            margin += tree.value[_places(bins, tree, depth)]
        return bins, np.concatenate([np.frombuffer(r[1], np.uint8) for r in held]), margin

    def run(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, n = [], 0
        for r in rows:
            held.append(r)
            n += len(r[1])
            if n >= BLOCK:
                yield made(held)
                held, n = [], 0
        if held:
            yield made(held)

    return pieces.mapPartitions(run)


def _moved(blocks: RDD, tree: Tree, depth: int) -> RDD:
    """The blocks with the margins after one more tree."""
    return blocks.mapPartitions(lambda it: ((bins, yes, margin + tree.value[_places(bins, tree, depth)]) for bins, yes, margin in it))


def _targets(yes: np.ndarray, margin: np.ndarray, first: bool) -> np.ndarray:
    y = yes * 2.0 - 1
    return y if first else 4 * y / (1 + np.exp(2 * y * margin))


def level_sums(blocks: Iterator, tree: Tree, level: int, bins: int, first: bool, squares: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sums of targets (and of their squares) by node of the level, class, feature and bin; and the nodes' square sums by class."""
    nodes, start, cells = 2**level, 2**level - 1, 2**level * 2 * bins
    out = own = None
    for held, yes, margin in blocks:
        at = _places(held, tree, level) - start
        t = _targets(yes, margin, first)
        open_rows = np.flatnonzero(at >= 0)  # rows in leaves of higher levels take no part
        if len(open_rows) < len(at):
            at, t, yes, held = at[open_rows], t[open_rows], yes[open_rows], held[:, open_rows]
        node = at * 2 + yes
        if out is None:
            out, own = np.zeros((2 + squares, len(held), cells)), np.zeros(nodes * 2)
        square = t * t
        own += np.bincount(node, weights=square, minlength=nodes * 2)
        node *= bins
        place = np.empty_like(node)
        for j, values in enumerate(held):
            np.add(node, values, out=place)
            out[0, j] += np.bincount(place, minlength=cells)
            out[1, j] += np.bincount(place, weights=t, minlength=cells)
            if squares:
                out[2, j] += np.bincount(place, weights=square, minlength=cells)
    return out, own


def _summed(blocks: RDD, *how) -> tuple[np.ndarray, np.ndarray]:
    def run(it: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sums = level_sums(it, *how)
        if sums[0] is not None:
            yield sums

    parts = blocks.mapPartitions(run)
    if blocks.getNumPartitions() > DIRECT:
        return parts.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    found = parts.collect()
    return sum(f[0] for f in found), sum(f[1] for f in found)


def _split_level(tree: Tree, level: int, depth: int, sums: np.ndarray, own: np.ndarray, class_weight: np.ndarray, bins: int, n_cuts: np.ndarray) -> bool:
    """Chooses the best split of every node of a level as MLlib does, the first one on a tie. True if any node was split."""
    nodes, start = 2**level, 2**level - 1
    by = sums.reshape(len(sums), -1, nodes, 2, bins)  # statistic, feature, node, class, bin
    rows = by[0].sum(2)
    weight, total = (np.einsum("fncb,c->fnb", s, class_weight) for s in by[:2])
    square = np.einsum("fncb,c->fnb", by[2], class_weight) if len(by) > 2 else None
    node_square = own.reshape(nodes, 2) @ class_weight
    left_rows, left_weight, left_total = rows.cumsum(2), weight.cumsum(2), total.cumsum(2)
    left_square = None if square is None else square.cumsum(2)
    any_split = False
    for i in range(nodes):
        at = start + i
        if at and (tree.feature[(at - 1) // 2] < 0):
            continue
        n, w, s, q = left_rows[0, i, -1], left_weight[0, i, -1], left_total[0, i, -1], node_square[i]
        tree.stats[at] = (w, s, q, int(n))
        if not n or (q - s * s / w) / w < PURE:
            continue
        lw, ls = left_weight[:, i], left_total[:, i]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (ls * ls / lw + (s - ls) ** 2 / (w - lw) - s * s / w) / w
        valid = (left_rows[:, i] > 0) & (left_rows[:, i] < n) & (np.arange(bins) < n_cuts[:, None])
        gain = np.where(valid, gain, -np.inf)
        f, b = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[f, b] <= 1e-14 * q / w:  # nothing beyond rounding
            continue
        tree.feature[at], tree.cut[at], tree.gain[at] = f, b, float(gain[f, b])
        any_split = True
        ln, lq = left_rows[f, i, b], 0.0 if left_square is None else left_square[f, i, b]  # without squares the next level fills them in
        tree.stats[2 * at + 1] = (lw[f, b], ls[f, b], lq, int(ln))
        tree.stats[2 * at + 2] = (w - lw[f, b], s - ls[f, b], q - lq, int(n - ln))
    return any_split


def _node_rows(number: int, tree: Tree, cuts: list[np.ndarray]) -> list[tuple]:
    """The nodes in MLlib's layout, numbered in preorder; two leaves with the same prediction are one, as in MLlib."""
    def mean(at: int) -> float:
        return float(tree.stats[at][1] / tree.stats[at][0])

    def leaf(at: int) -> bool:
        if tree.feature[at] < 0:
            return True
        left, right = leaf(2 * at + 1), leaf(2 * at + 2)
        if left and right and mean(2 * at + 1) == mean(2 * at + 2):
            tree.feature[at] = -1
        return bool(tree.feature[at] < 0)

    leaf(0)
    out: list = []

    def visit(at: int) -> int:
        me = len(out)
        out.append(None)
        w, s, q, n = tree.stats[at]
        inner = tree.feature[at] >= 0
        left, right = (visit(2 * at + 1), visit(2 * at + 2)) if inner else (-1, -1)
        split = (int(tree.feature[at]), [float(cuts[tree.feature[at]][tree.cut[at]])], -1) if inner else (-1, [], -1)
        out[me] = (number, (me, mean(at), max(float((q - s * s / w) / w), 0.0), [float(w), float(s), float(q)], n, tree.gain[at] if inner else -1.0, left, right, split))
        return me

    visit(0)
    return out


def _loaded(spark, estimator: GBTClassifier, trees: list[Tree], cuts: list[np.ndarray], rate: float) -> GBTClassificationModel:
    """The trees as MLlib's model, written in its layout beside the estimator's own parameters."""
    path = shared_folder(spark, "boosted-trees")
    estimator.save(f"{path}/estimator")
    about = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
    of_tree = about | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel",
                       **{k: {p: v for p, v in about[k].items() if p not in ("maxIter", "stepSize", "featureSubsetStrategy", "lossType", "probabilityCol", "rawPredictionCol",
                                                                            "subsamplingRate", "validationTol")} for k in ("paramMap", "defaultParamMap")}}
    of_model = about | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "numFeatures": len(cuts), "numTrees": len(trees)}
    model = f"{path}/model"
    spark.createDataFrame([(json.dumps(of_model),)], "value string").coalesce(1).write.text(f"{model}/metadata")
    kinds = [(i, json.dumps(of_tree | {"uid": f"dtr_{uuid.uuid4().hex[:12]}"}), rate if i else 1.0) for i in range(len(trees))]
    spark.createDataFrame(kinds, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{model}/treesMetadata")
    nodes = [row for i, tree in enumerate(trees) for row in _node_rows(i, tree, cuts)]
    spark.createDataFrame(nodes, NODE).coalesce(1).write.parquet(f"{model}/data")
    return GBTClassificationModel.load(model)


def fit(train: DataFrame, features: list[str], estimator: GBTClassifier) -> GBTClassificationModel:
    """The model of ``estimator`` for checkpointed rows with ``features``, its label (0 or 1) and its weight, which must depend on the label only."""
    spark = train.sparkSession
    label, weight = estimator.getLabelCol(), estimator.getWeightCol()
    rounds, rate, depth, seed = estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth(), estimator.getSeed()
    classes = {int(r[0]): (r.w, r.n) for r in train.groupBy(label).agg(F.first(weight).alias("w"), F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n = sum(c[1] for c in classes.values())
    if not n:
        raise ValueError("no rows to train on")
    class_weight = np.array([classes.get(c, (0.0, 0))[0] for c in (0, 1)])
    bins = min(estimator.getMaxBins(), n)
    wanted = max(bins**2, 10_000)
    some = _sample(train.select(*features, label), wanted / n, seed).toPandas()  # the size is fixed; only thresholds come from it
    some_weight = class_weight[some[label].to_numpy().astype(int)]
    total = min(wanted / n, 1.0) * sum(w * rows for w, rows in classes.values())
    cuts = [thresholds(some[f].to_numpy(dtype=float), some_weight, bins, total) for f in features]
    bins, n_cuts = max(len(c) for c in cuts) + 1, np.array([len(c) for c in cuts])
    tasks = min(spark.sparkContext.defaultParallelism, -(-n // BLOCK))
    pieces = _pieces(train, features, label, cuts).repartition(tasks).checkpoint().rdd.map(tuple)
    trees: list[Tree] = []
    held = []
    for done in range(rounds):
        if done % REBUILD == 0:
            blocks = _blocks(pieces, len(features), [t.bare() for t in trees], depth)
        else:
            blocks = _moved(blocks, trees[-1].bare(), depth)
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        tree = Tree.empty(depth)
        for level in range(depth):
            sums = _summed(blocks, tree.bare(), level, bins, done == 0, level == depth - 1)
            if not _split_level(tree, level, depth, *sums, class_weight, bins, n_cuts):
                break
        for at, (w, s, *_) in tree.stats.items():
            tree.value[at] = s / w * (rate if done else 1.0)
        trees.append(tree)
        held.append(blocks)
        if len(held) > 1:
            held.pop(0).unpersist()
    held.pop().unpersist()
    return _loaded(spark, estimator, trees, cuts, rate)
