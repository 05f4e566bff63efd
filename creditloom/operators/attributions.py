"""Additive per-row feature contributions of the default model and the factor lists built from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import fixedvalues as fv


@dataclass(frozen=True)
class Leaves:
    """Leaves with paths over the same number k of features: the features, the interval (low, high] of each that leads to the leaf,
    the share of training rows that pass each test, and the leaf's weighted prediction. Arrays of n by k, the last of n."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def contribution_tables(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contributions of every feature of every leaf for every pattern of tests passed: n by k by 2**k, bit j of a pattern for feature j.

    Without the features outside a coalition a path test passes with its share of training rows; over all
    coalitions this gives the Shapley value of a product, whose weights come from a small polynomial. All leaves are done at once.
    """
    n, k = share.shape
    passed = ((np.arange(2**k)[:, None] >> np.arange(k)) & 1).astype(float)
    weight = np.array([factorial(s) * factorial(k - 1 - s) / factorial(k) for s in range(k)])
    out = np.empty((n, k, 2**k))
    for j in range(k):
        poly = np.zeros((n, 2**k, k))
        poly[:, :, 0] = 1.0
        for done, i in enumerate(i for i in range(k) if i != j):
            # Coefficients above the number of features taken so far are zero.
            lower = poly[:, :, :done + 1] * passed[None, :, i, None]
            poly[:, :, :done + 1] *= share[:, i, None, None]
            poly[:, :, 1:done + 2] += lower
        out[:, j] = value[:, None] * (passed[None, :, j] - share[:, j, None]) * (poly @ weight)
    return out


def model_leaves(spark: SparkSession, path: str, model: PipelineModel) -> tuple[list[Leaves], float]:
    """Leaves of the stored model, by the number of features on their paths, and its mean margin. The node table is bounded by rounds and depth."""
    stored = spark.read.parquet(f"{path}/version-*/stages/*_{model.stages[-1].uid}/data")
    columns = ["nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex"]
    nodes: dict[int, dict[int, object]] = {}
    for row in stored.select("treeID", *columns, F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).collect():
        nodes.setdefault(row.treeID, {})[row.id] = row
    by_size: dict[int, list] = {}
    base = 0.0
    for tree, tree_weight in enumerate(model.stages[-1].treeWeights):
        stack = [(0, {}, 1.0)]
        while stack:
            at, tests, reach = stack.pop()
            node = nodes[tree][at]
            if node.leftChild < 0:
                base += reach * node.prediction * tree_weight
                if tests:
                    by_size.setdefault(len(tests), []).append((list(tests), *zip(*tests.values(), strict=True), node.prediction * tree_weight))
                continue
            for child, is_left in ((node.leftChild, True), (node.rightChild, False)):
                part = nodes[tree][child].rawCount / node.rawCount
                low, high, share = tests.get(node.featureIndex, [-np.inf, np.inf, 1.0])
                bounds = [low, min(high, node.threshold), share * part] if is_left else [max(low, node.threshold), high, share * part]
                stack.append((child, {**tests, node.featureIndex: bounds}, reach * part))
    return [Leaves(*(np.array(c) for c in zip(*found, strict=True))) for _, found in sorted(by_size.items())], base


def contributions(x: np.ndarray, leaves: list[Leaves], tables: list[np.ndarray]) -> np.ndarray:
    """Contributions of every feature (first axis) to every row of ``x``. Each test is made once for all leaves that share it."""
    columns = np.ascontiguousarray(x.T)
    out, part = np.zeros(columns.shape), np.empty(len(x))
    tests: dict[tuple, np.ndarray] = {}
    for group, table in zip(leaves, tables, strict=True):
        for feats, low, high, own in zip(group.features.tolist(), group.low.tolist(), group.high.tolist(), table, strict=True):
            pattern = np.zeros(len(x), np.uint16)
            for j, test in enumerate(zip(feats, low, high, strict=True)):
                passed = tests.get(test)
                if passed is None:
                    values = columns[test[0]]
                    tests[test] = passed = ((values > test[1]) & (values <= test[2])).astype(np.uint16)
                pattern |= passed << np.uint16(j)
            for j, f in enumerate(feats):
                out[f] += np.take(own[j], pattern, out=part, mode="clip")
    return out


def attributions_wide(features: DataFrame, model: PipelineModel, path: str, key: str = "loan_id") -> DataFrame:
    """One column of contribution per feature plus the mean margin; together they give the raw prediction.

    What is broadcast are the leaves, a few numbers for each test; their tables are made once in each task.
    """
    spark = features.sparkSession
    leaves, base = model_leaves(spark, path, model)
    shared = spark.sparkContext.broadcast(leaves)
    names = list(fv.MODEL_FEATURES)

    def contribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = None
        for pdf in batches:
            if tables is None:
                tables = [contribution_tables(group.share, group.value) for group in shared.value]
            result = pd.DataFrame(contributions(pdf[names].to_numpy(dtype=float), shared.value, tables).T, columns=names)
            result.insert(0, key, pdf[key].to_numpy())
            result["base"] = base
            yield result

    kind = dict(features.dtypes)[key]
    schema = ", ".join([f"{key} {kind}", *[f"{n} double" for n in names], "base double"])
    return features.select(key, *names).mapInPandas(contribute, schema)


def attributions(features: DataFrame, model: PipelineModel, path: str, key: str = "loan_id") -> DataFrame:
    """(key, feature, impact) rows in margin units; positive impacts push toward default."""
    wide = attributions_wide(features, model, path, key)
    return wide.unpivot(key, fv.MODEL_FEATURES, "feature", "impact").withColumn("impact", F.round("impact", 4))


def _ranked(items: str, kind: str, sign: int, k: int) -> Column:
    by = F.array_sort(F.transform(items, lambda x: F.struct((x.impact * sign).alias("s"), x.ord.alias("ord"), x.feature.alias("feature"), x.impact.alias("impact"))))
    return F.transform(F.slice(by, 1, k), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), (i + 1).alias("rank"), x.feature.alias("feature"), x.impact.alias("impact")))


def _listed(attr: DataFrame, key: str) -> DataFrame:
    """All impacts of a row as one list. A row has one impact per feature, so a list holds at most twelve entries."""
    order = F.array_position(F.array(*[F.lit(f) for f in fv.MODEL_FEATURES]), F.col("feature")).cast("int").alias("ord")
    return attr.groupBy(key).agg(F.collect_list(F.struct("impact", order, "feature")).alias("_all"))


def top_factors(attr: DataFrame, k: int = 3, key: str = "loan_id") -> DataFrame:
    """The ``k`` largest and ``k`` smallest impacts per row, ties in feature order."""
    return _listed(attr, key).select(key, F.inline(F.concat(_ranked("_all", "risk", -1, k), _ranked("_all", "positive", 1, k))))


def factor_chart_of_wide(wide: DataFrame, k: int = 3, key: str = "loan_id") -> DataFrame:
    """``factor_chart`` of the top factors, straight from the wide contributions: sorted in the row, without a shuffle."""
    items = F.array(*[F.struct(F.round(f, 4).alias("impact"), F.lit(i + 1).alias("ord"), F.lit(f).alias("feature")) for i, f in enumerate(fv.MODEL_FEATURES)])
    return _chart(wide.select(key, items.alias("_all")), k, key)


def factor_chart_of_rows(attr: DataFrame, k: int = 3, key: str = "loan_id") -> DataFrame:
    """``factor_chart`` of the top factors of (key, feature, impact) rows: one shuffle, the rest inside the row."""
    return _chart(_listed(attr, key), k, key)


def _chart(lists: DataFrame, k: int, key: str) -> DataFrame:
    lists = lists.select(key, _ranked("_all", "risk", -1, k).alias("_risk"), _ranked("_all", "positive", 1, k).alias("_good"))
    only_risk = F.filter("_risk", lambda r: ~F.exists("_good", lambda p: p.feature == r.feature))
    chart = F.transform(F.concat(only_risk, F.col("_good")), lambda x: F.struct(
        x.feature.alias("feature"), x.impact.alias("impact"), F.when(x.impact > 0, "Risk").otherwise("Positive").alias("type")))
    return lists.select(key, F.inline(chart))


def factor_chart(factors: DataFrame, key: str = "loan_id") -> DataFrame:
    """Risk and positive factors in one list per row; on the same feature the positive entry wins."""
    later = (F.col("kind") == "positive").cast("int")
    merged = factors.groupBy(key, "feature").agg(F.max_by("impact", later).alias("impact"))
    return merged.withColumn("type", F.when(F.col("impact") > 0, "Risk").otherwise("Positive"))
