"""Boosting on binned blocks against MLlib's own, and how its rows are dealt."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditloom.operators import boosting
from creditloom.session import ensure_checkpoint_dir

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def train(spark):
    """3000 rows in one partition; labels are noisy, so that no node is pure and no two splits are alike."""
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 9, 3000), rng.exponential(size=3000)])
    y = (x[:, 0] + 0.3 * x[:, 1] - x[:, 2] + rng.normal(size=3000) > 0.5).astype(int)
    rows = [(i, *map(float, r), int(t), 1.5 if t else 0.75) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label int, weight double").coalesce(1).checkpoint()


def estimator(rounds):
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, stepSize=0.1, maxDepth=4, seed=42)


def test_trees_are_those_of_mllib(train, monkeypatch):
    """Also when the margins are made anew from the binned rows and all trees."""
    monkeypatch.setattr(boosting, "REBUILD", 3)
    table = VectorAssembler(inputCols=NAMES, outputCol="features").transform(train)
    ours, theirs = boosting.fit(train, NAMES, estimator(8)), estimator(8).fit(table)
    assert ours.treeWeights == theirs.treeWeights and ours.numFeatures == theirs.numFeatures and ours.getMaxDepth() == 4
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees]
    assert np.array(ours.featureImportances) == pytest.approx(np.array(theirs.featureImportances), rel=1e-6)
    raw = [m.transform(table).select("id", vector_to_array("rawPrediction")[1].alias(n)) for m, n in ((ours, "p"), (theirs, "q"))]
    assert raw[0].join(raw[1], "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_rows_of_one_partition_are_dealt_over_tasks(train, monkeypatch):
    """A table stored as one row group used to be boosted by one task."""
    dealt, summed = [], boosting._summed
    monkeypatch.setattr(boosting, "BLOCK", 500)
    monkeypatch.setattr(boosting, "PIECE", 100)
    monkeypatch.setattr(boosting, "_summed", lambda blocks, *how: dealt.append([sum(p) for p in blocks.map(lambda b: len(b[1])).glom().collect()]) or summed(blocks, *how))
    boosting.fit(train, NAMES, estimator(1))
    assert train.rdd.getNumPartitions() == 1
    assert all(sum(n) == 3000 and len([x for x in n if x]) == 6 and max(n) <= 800 for n in dealt)


def test_one_class_and_no_rows(train):
    only = boosting.fit(train.where("label = 1"), NAMES, estimator(2))
    assert [t.numNodes for t in only.trees] == [1, 1]
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(train.where("label = 2"), NAMES, estimator(2))


def test_thresholds_come_from_the_rows_mllib_draws(spark):
    """Beyond 10,000 rows thresholds are taken from a sample."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(11_000, 3))
    rows = [(*map(float, r), int(t), 1.25 if t else 0.75) for r, t in zip(x, x.sum(1) + rng.normal(size=11_000) > 0, strict=True)]
    table = spark.createDataFrame(rows, "a double, b double, c double, label int, weight double").coalesce(1).checkpoint()
    theirs = estimator(3).fit(VectorAssembler(inputCols=NAMES, outputCol="features").transform(table))
    ours = boosting.fit(table, NAMES, estimator(3))
    tests = [[line.strip() for t in m.trees for line in t.toDebugString.split("\n") if "If (" in line] for m in (ours, theirs)]
    assert len(tests[0]) > 20 and tests[0] == tests[1]
