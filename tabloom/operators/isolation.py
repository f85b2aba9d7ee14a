"""Isolation forest.

Trees see a bounded subsample (256 rows each) that is drawn by hash and grown in parallel, one group per
tree; the node table (at most 511 rows per tree) is what every scoring task holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.operators.quantiles import exact_percentiles
from tabloom.session import pin, spread

NODE_SCHEMA = "tree int, node int, feature int, split double, left int, right int, size int"


def _mean_depth(n):
    """Average depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    long = 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(limit: int, seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.stack(pdf.sort_values(["_h", "_key"])["_x"].to_numpy())
        nodes, queue = [], [(0, np.arange(len(x)), 0)]
        taken = 1
        while queue:
            node, rows, depth = queue.pop()
            spread = x[rows].max(axis=0) > x[rows].min(axis=0)
            if depth >= limit or len(rows) <= 1 or not spread.any():
                nodes.append((tree, node, -1, 0.0, -1, -1, len(rows)))
                continue
            f = int(rng.choice(np.flatnonzero(spread)))
            values = x[rows, f]
            cut = float(rng.uniform(values.min(), values.max()))
            low = values <= cut
            nodes.append((tree, node, f, cut, taken, taken + 1, len(rows)))
            queue += [(taken, rows[low], depth + 1), (taken + 1, rows[~low], depth + 1)]
            taken += 2
        return pd.DataFrame(nodes, columns=[c.split(" ")[0] for c in NODE_SCHEMA.split(", ")])

    return grow


def usable(features: Column) -> Column:
    """Whether a row has a vector without missing components; others are not fitted on and get a null score."""
    return F.coalesce(F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size(features) > 0), F.lit(False))


class IsolationForest:
    """Anomaly scores 2^(-E[depth] / c(psi)); the top share is flagged."""

    def __init__(self, nodes: pd.DataFrame, n_trees: int, sample: int, limit: int):
        self.n_trees, self.sample, self.limit = n_trees, sample, limit
        shape = (n_trees, 2 * self.sample)
        self.feature, self.left, self.right = (np.full(shape, -1, dtype=np.int32) for _ in range(3))
        self.split, self.leaf = np.zeros(shape), np.zeros(shape)
        t, n = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        self.feature[t, n], self.left[t, n], self.right[t, n] = nodes["feature"], nodes["left"], nodes["right"]
        self.split[t, n], self.leaf[t, n] = nodes["split"], _mean_depth(nodes["size"])

    @classmethod
    def fit(cls, df: DataFrame, features: Column, key: Column, n_trees: int = 100, sample: int = 256, seed: int = 42) -> "IsolationForest":
        """`features` is an array<double> expression, `key` a unique row key.

        A first hash keeps a pool of some 8 * trees * sample rows, a second one per tree draws from it, and
        the `sample` smallest hashes of each tree are used.
        """
        rows = spread(df.where(usable(features)).select(features.alias("_x"), key.cast("string").alias("_key")))
        n = rows.count()
        wide = 1 << 62
        unit = F.xxhash64(F.col("_key"), F.lit(seed)).bitwiseAND(F.lit(wide - 1))
        share = min(1.0, 8 * n_trees * sample / max(n, 1))
        pool = rows if share >= 1.0 else rows.where(unit < int(share * wide))
        per_tree = min(1.0, 4 * sample / max(n * share, 1))
        draw = lambda t: F.xxhash64(F.col("_key"), t, F.lit(seed)).bitwiseAND(F.lit(wide - 1))
        trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) <= int(per_tree * (wide - 1)))
        drawn = pool.withColumn("tree", F.explode(trees)).withColumn("_h", draw(F.col("tree")))
        place = F.row_number().over(W.partitionBy("tree").orderBy("_h", "_key"))
        chosen = drawn.withColumn("_p", place).where(F.col("_p") <= sample).drop("_p")
        size = max(2, min(sample, n))
        limit = math.ceil(math.log2(size))
        nodes = chosen.groupBy("tree").applyInPandas(_grow(limit, seed), NODE_SCHEMA).toPandas()
        return cls(nodes, n_trees, size, limit)

    def score(self, df: DataFrame, features: Column, name: str = "Anomaly_Score") -> DataFrame:
        """Adds the score, null for rows without a usable vector; one vectorised walk per batch through all trees."""
        feature, split, left, right, leaf = self.feature, self.split, self.left, self.right, self.leaf
        n_trees, limit, norm = self.n_trees, self.limit, float(_mean_depth(self.sample))

        def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                out = pd.Series(np.nan, index=range(len(batch)))  # missing ones become null
                known = batch.notna().to_numpy()
                if not known.any():
                    yield out
                    continue
                x = np.stack(batch.to_numpy()[known])
                index, total = np.arange(len(x)), np.zeros(len(x))
                for t in range(n_trees):
                    at = np.zeros(len(x), dtype=np.int32)
                    for _ in range(limit):
                        f = feature[t, at]
                        inner = f >= 0
                        total += inner
                        step = np.where(x[index, np.maximum(f, 0)] <= split[t, at], left[t, at], right[t, at])
                        at = np.where(inner, step, at)
                    total += leaf[t, at]
                out[known] = np.power(2.0, -total / n_trees / norm)
                yield out

        return df.withColumn(name, F.pandas_udf(walk, "double")(F.when(usable(features), features)))

    def assign(self, df: DataFrame, features: Column, contamination: float = 0.05) -> DataFrame:
        """Adds `Anomaly_Score` and `Anomaly`: 1 above the exact (1 - contamination) percentile of the scores, null for rows
        without a score. The scored table is stored, so that no row is scored twice."""
        scored = pin(self.score(spread(df), features))
        cut = exact_percentiles(scored, {"Anomaly_Score": [1 - contamination]})["Anomaly_Score"][0]
        return scored.withColumn("Anomaly", (F.col("Anomaly_Score") > F.lit(cut)).cast("int"))
