"""Exact Shapley attributions of tree models, over the trees instead of sampled feature orders.

What a tree expects of a row when only some features are known follows the row at splits on known features and both
sides, weighted by the training rows that went there, at the others. For one leaf that expectation is a product over
the features on its path: 1 or 0 for a known feature (the row keeps to the path or not), the share of training rows
that kept to it for an unknown one. The Shapley value of a product is an integral of a polynomial, which a quadrature
with half as many points as features on the path gives exactly. So a leaf costs a few vector operations for a block of
rows, no background rows are needed, and the values add up to the prediction minus the expectation of the trees.

The table of leaves is broadcast after a check of its size; rows stay in their partitions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.models import TrainedModel
from tabloom.session import scratch_path

#: Nodes of a model that may be broadcast (some 100 bytes each).
MAX_NODES = 1_000_000
#: Rows worked on at once.
BLOCK = 4096


class Leaf:
    """A leaf: its value, and for each feature on its path the interval (low, high] and the share of training rows."""

    def __init__(self, value: float, path: dict[int, tuple[float, float, float]]):
        self.value = value
        self.features = np.array(list(path), dtype=np.int64)
        bounds = np.array(list(path.values()), dtype=np.float64).reshape(len(path), 3)
        self.low, self.high, self.share = bounds.T


def node_rows(spark: SparkSession, model) -> list[dict]:
    """The nodes of a fitted forest, boosted or single tree, as it stores them."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    if "treeID" not in stored.columns:
        stored = stored.select(F.lit(0).alias("treeID"), F.struct(*stored.columns).alias("nodeData"))
    nodes = stored.select("treeID", "nodeData.*")
    if nodes.count() > MAX_NODES:
        raise ValueError(f"the model has more than {MAX_NODES} nodes")
    return [r.asDict(recursive=True) for r in nodes.collect()]  # checked above


def leaves_of(nodes: list[dict], weights: list[float], class_index: int | None) -> list[Leaf]:
    """The leaves of all trees, their values multiplied by the weight of the tree."""
    trees: dict[int, dict[int, dict]] = defaultdict(dict)
    for n in nodes:
        trees[n["treeID"]][n["id"]] = n

    def value(node: dict) -> float:
        if class_index is None:
            return node["prediction"]
        stats = node["impurityStats"]
        return stats[class_index] / sum(stats)

    out = []
    for number, tree in trees.items():
        todo = [(tree[0], {})]
        while todo:
            node, path = todo.pop()
            if node["leftChild"] < 0:
                out.append(Leaf(weights[number] * value(node), path))
                continue
            split = node["split"]
            if split["numCategories"] >= 0:
                raise ValueError("splits on sets of categories are not explained")
            feature, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in (("leftChild", (low, min(high, cut))), ("rightChild", (max(low, cut), high))):
                side = tree[node[child]]
                todo.append((side, {**path, feature: (*bounds, share * side["rawCount"] / node["rawCount"])}))
    return out


def attributions(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of a block of rows, one column a feature, and the expectation that they add to."""
    out, base = np.zeros_like(x), 0.0
    for leaf in leaves:
        base += leaf.value * leaf.share.prod()
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        kept = ((own > leaf.low) & (own <= leaf.high)).astype(np.float64)
        points, sizes = np.polynomial.legendre.leggauss((d + 1) // 2)
        total = np.zeros_like(own)
        for t, size in zip((points + 1) / 2, sizes / 2):
            factor = t * kept + (1 - t) * leaf.share
            total += size * factor.prod(axis=1, keepdims=True) / factor
        out[:, leaf.features] += leaf.value * (kept - leaf.share) * total
    return out, base


def tree_weights(model) -> list[float]:
    """Weight of each tree in the prediction: those of boosting, equal shares of a forest."""
    if not hasattr(model, "treeWeights"):
        return [1.0]
    weights = list(model.treeWeights)
    return [w / len(weights) for w in weights] if "RandomForest" in type(model).__name__ else weights


def feature_names(model: TrainedModel) -> list[str]:
    """The column that each component of the feature vector comes from."""
    assembly = model.assembly
    words = [c for c in assembly.text for _ in assembly.tfidf[c].vocabulary]
    return [*assembly.numeric, *assembly.categorical, *words]


def explain_trees(model: TrainedModel, df: DataFrame, key: str, class_index: int = 1) -> DataFrame:
    """(key, feature, attribution, expected) of every row and column; the attributions of a row and `expected` add up to
    its prediction, for forest classifiers to the probability of the class, for boosted classifiers to the margin.

    Components of a text column are added up. Only tree models are explained; a model of single leaves has zeros.
    """
    fitted = model.model
    name = type(fitted).__name__
    if not any(kind in name for kind in ("RandomForest", "GBT", "DecisionTree")):
        raise ValueError(f"{name} is not a tree model")
    by_class = class_index if "Classification" in name and "GBT" not in name else None
    leaves = leaves_of(node_rows(df.sparkSession, fitted), tree_weights(fitted), by_class)
    names = feature_names(model)
    columns = list(dict.fromkeys(names))
    place = np.array([columns.index(n) for n in names], dtype=np.int64)
    shared = df.sparkSession.sparkContext.broadcast(leaves)

    def explain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), BLOCK):
                part = frame.iloc[lo : lo + BLOCK]
                values, base = attributions(shared.value, np.stack(part["x"].to_numpy()).astype(np.float64))
                summed = np.zeros((len(part), len(columns)))
                np.add.at(summed.T, place, values.T)
                yield pd.DataFrame(
                    {
                        key: np.repeat(part[key].to_numpy(), len(columns)),
                        "feature": np.tile(np.array(columns, dtype=object), len(part)),
                        "attribution": summed.ravel(),
                        "expected": base,
                    }
                )

    encoded = model.assembly.transform(df).select(F.col(f"`{key}`"), vector_to_array("features").alias("x"))
    kind = df.schema[key].dataType.simpleString()
    return encoded.mapInPandas(explain, f"`{key}` {kind}, feature string, attribution double, expected double")
