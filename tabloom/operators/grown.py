"""Extremely randomised trees and softmax boosting, grown level by level over histograms.

Features become small bin numbers once. Each level of all trees under growth is one job: tasks walk their rows to the
open nodes and emit the sums of each (tree, node, feature, bin) they met, Spark adds them up, and window sums over the
bins of a feature give every possible split; the driver receives one row per open node. What is shuffled depends on the
model's size and the number of tasks, not on the rows.

One criterion serves all: a side with sums s_1..s_k over a mass m is worth (s_1^2 + .. + s_k^2) / (m + ridge). With class
weights that is the Gini criterion, with targets the variance, with gradients over curvatures the Newton gain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.operators.pipelines import Stage, _read_json, _write_json

#: Features whose quantiles are taken in one scan.
FEATURES_A_SCAN = 200
#: Histogram figures a task holds at once; a level with more open nodes takes several jobs.
CELLS = 4_000_000


def bin_edges(table: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Sorted upper edges of the bins of each feature: its distinct quantiles, the largest value among them."""
    shares = [i / bins for i in range(bins + 1)]
    edges = []
    x = table.select(vector_to_array("features").alias("x"))
    for start in range(0, width, FEATURES_A_SCAN):
        known = [F.when(~F.isnan(v), v) for v in (F.get("x", F.lit(i)) for i in range(start, min(width, start + FEATURES_A_SCAN)))]
        row = x.agg(*[F.percentile_approx(v, shares, 50 * bins).alias(f"q{i}") for i, v in enumerate(known)]).first()
        edges += [np.unique(np.array(q if q else [0.0])) for q in row]
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges below each value; a missing value goes to the first bin."""
    out = np.empty(x.shape, dtype=np.uint8)
    for f, edge in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(edge, x[:, f], side="left"))
    return out


class Tree:
    """A tree as a heap: the children of node i are 2i + 1 and 2i + 2; a feature of -1 marks a leaf."""

    def __init__(self, depth: int, width: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(size, -1, dtype=np.int32)
        self.cut = np.zeros(size, dtype=np.int32)  # last bin that goes left
        self.edge = np.zeros(size)  # largest value that goes left
        self.value = np.zeros((size, width))

    def walk(self, rows: np.ndarray, by: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node each row ends in, or comes to after some levels; `by` is `cut` for bins and `edge` for values. A
        missing value goes left."""
        at, index = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[at]
            right = rows[index, np.maximum(f, 0)] > by[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at

    def state(self) -> dict:
        return {"depth": self.depth} | {n: getattr(self, n).tolist() for n in ("feature", "cut", "edge", "value")}

    @classmethod
    def of(cls, state: dict) -> "Tree":
        tree = cls(state["depth"], len(state["value"][0]))
        for name in ("feature", "cut", "edge", "value"):
            setattr(tree, name, np.array(state[name], dtype=getattr(tree, name).dtype))
        return tree


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists or bytes of one length as a matrix, without a step in Python for each row."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of numbers."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(ends, np.ascontiguousarray(rows, dtype=np.float64).ravel())


def _bytes(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of small numbers as bytes."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _histogram(
    trees: list[Tree], opened: list[tuple[int, int, np.ndarray]], level: int, edges: list[np.ndarray], bins: int, shared: bool, width: int
):
    """Map of batches to cells. `opened` holds (tree, node, candidate features) of a level; a row has bins, sums and
    masses, which are one set for all trees (`shared`) or one for each."""
    m = len(opened[0][2])
    slots: dict[int, list[tuple[int, int]]] = {}
    for slot, (tree, node, _) in enumerate(opened):
        slots.setdefault(tree, []).append((node, slot))
    wanted = np.stack([c for _, _, c in opened])
    names = [f"s{i}" for i in range(width)] + ["mass", "n"]

    def cells(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width + 2, len(opened) * m * (bins + 2)))
        for frame in frames:
            if not frame.num_rows:
                continue
            rows, sums, masses = (_matrix(frame.column(c)) for c in ("bins", "sums", "masses"))
            for tree, nodes in slots.items():
                place = np.full(len(trees[tree].feature), -1, dtype=np.int64)
                for node, slot in nodes:
                    place[node] = slot
                slot = place[trees[tree].walk(rows, trees[tree].cut, level)]
                here = np.flatnonzero(slot >= 0)
                if not len(here):
                    continue
                slot = slot[here]
                seen = rows[here[:, None], wanted[slot]]
                index = ((slot[:, None] * m + np.arange(m)) * (bins + 2) + seen).ravel()
                own = sums[here] if shared else sums[here, tree : tree + 1]
                mass = masses[here, 0] if shared else masses[here, tree]
                for i, weights in enumerate([*own.T, mass, np.ones(len(here))]):
                    held[i] += np.bincount(index, weights=np.repeat(weights, m), minlength=held.shape[1])
        met = np.flatnonzero(held[-1])
        at, number = np.divmod(met, bins + 2)
        slot, j = np.divmod(at, m)
        out = {"tree": np.array([t for t, _, _ in opened])[slot], "node": np.array([n for _, n, _ in opened])[slot]}
        out |= {"feature": wanted[slot, j], "bin": number}
        edge = [edges[f][b] if b < len(edges[f]) else math.inf for f, b in zip(wanted[slot, j], number)]
        columns = {name: pa.array(c, pa.int32()) for name, c in out.items()} | {"edge": pa.array(edge, pa.float64())}
        yield pa.RecordBatch.from_pydict(columns | {name: pa.array(held[i][met]) for i, name in enumerate(names)})

    schema = "tree int, node int, feature int, bin int, edge double, " + ", ".join(f"{n} double" for n in names)
    return cells, schema, names


def best_splits(cells: DataFrame, names: list[str], ridge: float, min_rows: int, seed: int | None = None) -> DataFrame:
    """Per (tree, node) its totals and the split of most gain, if one has any: (tree, node, total, best).

    With a seed each feature offers one split only, at a value drawn evenly between its smallest and largest in the node.
    """
    # Tasks emit each cell once, so one exchange by feature serves the sums and the windows.
    summed = cells.repartition("tree", "node", "feature").groupBy("tree", "node", "feature", "bin", "edge").agg(*[F.sum(n).alias(n) for n in names])
    one = W.partitionBy("tree", "node", "feature")
    so_far = one.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    table = summed.select(
        "tree", "node", "feature", "bin", "edge", (F.col("bin") == F.max("bin").over(one)).alias("last"),
        F.array(*[F.sum(n).over(so_far) for n in names]).alias("left"), F.array(*[F.sum(n).over(one) for n in names]).alias("total"),
    )
    width = len(names) - 2

    def worth(side: Column) -> Column:
        squares = sum((side[i] * side[i] for i in range(width)), F.lit(0.0))
        return F.coalesce(F.try_divide(squares, side[width] + ridge), F.lit(0.0))

    right = F.zip_with("total", "left", lambda t, s: t - s)
    table = table.withColumn("right", right)
    gain = worth(F.col("left")) + worth(F.col("right")) - worth(F.col("total"))
    allowed = ~F.col("last") & (F.col("left")[width + 1] >= min_rows) & (F.col("right")[width + 1] >= min_rows)
    if seed is not None:
        # Nothing lies above the last bin, so the draw is between the first and the last but one.
        low, high = F.min("edge").over(one), F.max(F.when(~F.col("last"), F.col("edge"))).over(one)
        share = F.pmod(F.xxhash64(F.lit(seed), "tree", "node", "feature"), F.lit(1 << 30)) / float(1 << 30)
        table = table.withColumn("below", ~F.col("last") & (F.col("edge") <= low + share * (high - low)))
        table = table.withColumn("drawn", F.col("bin") == F.max(F.when(F.col("below"), F.col("bin"))).over(one))
        allowed = allowed & F.coalesce("drawn", F.lit(False))
    order = F.when(allowed & (gain > 1e-12), F.struct(gain.alias("gain"), -F.col("feature"), -F.col("bin")))
    return table.groupBy("tree", "node").agg(
        F.max_by("total", -F.col("feature")).alias("total"), F.max_by(F.struct("feature", "bin", "left"), order).alias("best")
    )


def grow(
    frame: DataFrame, n_trees: int, depth: int, edges: list[np.ndarray], bins: int, width: int, shared: bool, ridge: float,
    min_rows: int, tries: int, seed: int, random_cuts: bool,
) -> list[Tree]:
    """Grow trees side by side on rows with bins, sums and masses; `tries` features are drawn for each node.

    Leaves hold sums over mass.
    """
    trees = [Tree(depth, width) for _ in range(n_trees)]
    opened = [(t, 0) for t in range(n_trees)]
    at_once = max(1, CELLS // (tries * (bins + 2) * (width + 2)))
    for level in range(depth):
        if not opened:
            break
        wanted = []
        for t, node in opened:
            rng = np.random.default_rng([seed, t, node])
            wanted.append((t, node, np.sort(rng.choice(len(edges), tries, replace=False))))
        found = []
        for start in range(0, len(wanted), at_once):
            cells, schema, names = _histogram(trees, wanted[start : start + at_once], level, edges, bins, shared, width)
            splits = best_splits(frame.mapInArrow(cells, schema), names, ridge, min_rows, seed if random_cuts else None)
            found += splits.collect()  # one row an open node
        opened = []
        for row in found:
            tree, node, total = trees[row["tree"]], row["node"], np.array(row["total"])
            tree.value[node] = total[:width] / max(total[width] + ridge, 1e-12)
            if row["best"] is None:
                continue
            f, b, left = row["best"]["feature"], row["best"]["bin"], np.array(row["best"]["left"])
            tree.feature[node], tree.cut[node], tree.edge[node] = f, b, edges[f][b]
            for child, side in ((2 * node + 1, left), (2 * node + 2, total - left)):
                tree.value[child] = side[:width] / max(side[width] + ridge, 1e-12)
                if level + 1 < depth and side[width + 1] >= 2 * min_rows:
                    opened.append((row["tree"], child))
    return trees


class GrownModel(Stage):
    """Fitted trees; adds `prediction` and, for classes, `probability`. Rows without a vector get nulls.

    `kind` is "mean" (a tree's leaf holds class shares or the mean target; trees are averaged) or "softmax" (tree i adds
    to the margin of class i modulo the classes, from `start`).
    """

    def __init__(self, trees: list[Tree], kind: str, start: list[float], n_classes: int | None):
        super().__init__()
        self.trees, self.kind, self.start, self.n_classes = trees, kind, list(start), n_classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, kind, start = self.trees, self.kind, np.array(self.start)

        @F.arrow_udf("array<double>")
        def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                known = batch.is_valid().to_numpy(zero_copy_only=False)
                out = pa.nulls(len(batch), pa.list_(pa.float64()))
                if known.any():
                    x = _matrix(batch.drop_null())
                    total = np.tile(start, (len(x), 1))
                    for i, tree in enumerate(trees):
                        value = tree.value[tree.walk(x, tree.edge)]
                        if kind == "mean":
                            total += value / len(trees)
                        else:
                            total[:, i % len(start)] += value[:, 0]
                    if kind == "softmax":
                        total = _softmax(total)
                    # The place of a known row among the known ones; null for the others.
                    out = _lists(total).take(pa.array(np.cumsum(known) - 1, mask=~known))
                yield out

        values = F.when(F.col("features").isNotNull(), vector_to_array("features"))
        scored = dataset.withColumn("_scores", scores(values))
        if self.n_classes is None:
            return scored.withColumn("prediction", F.get("_scores", F.lit(0))).drop("_scores")
        best = (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double")
        probability = F.when(F.col("_scores").isNotNull(), array_to_vector("_scores"))
        return scored.withColumn("probability", probability).withColumn("prediction", best).drop("_scores")

    def write_state(self, spark: SparkSession, path: str) -> None:
        state = {"kind": self.kind, "start": self.start, "n_classes": self.n_classes}
        _write_json(spark, path, state | {"trees": [t.state() for t in self.trees]})

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "GrownModel":
        state = _read_json(spark, path)
        return cls(**(state | {"trees": [Tree.of(t) for t in state["trees"]]}))


def _softmax(margins: np.ndarray) -> np.ndarray:
    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


class _Grower(Estimator):
    """Common part: settings as plain attributes, the binned table and its release."""

    SETTINGS: dict = {}

    def __init__(self, **settings):
        super().__init__()
        self.weight = None
        self.settings = dict(self.SETTINGS)
        self.setParams(**settings)

    def setParams(self, **settings):
        for name in settings:
            if name not in self.SETTINGS:
                raise ValueError(f"unknown setting {name}")
        self.settings |= settings
        if not 2 <= self.settings["bins"] <= 250:
            raise ValueError("bins is 2 to 250")
        return self

    def setWeightCol(self, column: str):
        self.weight = column
        return self

    def _binned(self, dataset: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
        """label, weight and bins of rows with both label and features, kept on the executors."""
        weight = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        table = dataset.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "features")
        table = table.where("label is not null and features is not null and weight > 0")
        head = table.select(F.size(vector_to_array("features")).alias("n")).first()
        if head is None:
            raise ValueError("no rows to fit on")
        edges = bin_edges(table, head["n"], self.settings["bins"])

        def numbered(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                if frame.num_rows:
                    rows = binned(_matrix(frame.column("x")), edges)
                    yield pa.RecordBatch.from_pydict({"label": frame.column("label"), "weight": frame.column("weight"), "bins": _bytes(rows)})

        wide = table.select("label", "weight", vector_to_array("features").alias("x"))
        return wide.mapInArrow(numbered, "label double, weight double, bins binary").persist(StorageLevel.MEMORY_AND_DISK), edges


def class_count(table: DataFrame) -> int:
    return int(table.agg(F.max("label")).first()[0]) + 1


class ExtraTrees(_Grower):
    """Extremely randomised trees: every node tries some features, each at one random cut, on all rows.

    Classes are labels 0..k-1 (`task` "classification"); rows of a class without any row get a share of 0.
    """

    SETTINGS = {"task": "classification", "numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1, "tries": None, "bins": 64, "seed": 42}

    def _fit(self, dataset: DataFrame) -> GrownModel:
        s = self.settings
        table, edges = self._binned(dataset)
        try:
            if s["task"] == "classification":
                width, centre = class_count(table), 0.0
                sums = F.array(*[F.when(F.col("label") == c, F.col("weight")).otherwise(F.lit(0.0)) for c in range(width)])
            else:
                # Targets are taken from their mean, which keeps squared sums small.
                width, centre = 1, table.agg(F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()[0]
                sums = F.array((F.col("label") - F.lit(centre)) * F.col("weight"))
            frame = table.select("bins", sums.alias("sums"), F.array("weight").alias("masses"))
            n = len(edges)
            tries = min(n, s["tries"] or max(1, round(math.sqrt(n) if width > 1 else n / 3)))
            trees = grow(
                frame, s["numTrees"], s["maxDepth"], edges, s["bins"], width, True, 0.0, s["minInstancesPerNode"], tries, s["seed"], True
            )
        finally:
            table.unpersist()
        classes = width if s["task"] == "classification" else None
        return GrownModel(trees, "mean", [centre] * width, classes)


class SoftmaxBoosting(_Grower):
    """Boosted trees for any number of classes: each round grows one tree a class on the gradients of the softmax loss.

    Classes are labels 0..k-1; margins start at the logarithms of the class shares.
    """

    SETTINGS = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 1, "ridge": 1.0, "bins": 64, "seed": 42}

    def _fit(self, dataset: DataFrame) -> GrownModel:
        s = self.settings
        table, edges = self._binned(dataset)
        classes = class_count(table)
        shares = dict(table.groupBy("label").agg(F.sum("weight")).collect())
        total = sum(shares.values())
        start = [math.log(max(shares.get(float(c), 0.0) / total, 1e-9)) for c in range(classes)]
        trees: list[Tree] = []
        try:
            for _ in range(s["maxIter"]):
                # From the binned rows and all trees so far, so that a lost part is made again in one step.
                moved = table.mapInArrow(_gradients(list(trees), start), "bins binary, sums array<double>, masses array<double>")
                moved = moved.persist(StorageLevel.MEMORY_AND_DISK)
                grown = grow(
                    moved, classes, s["maxDepth"], edges, s["bins"], 1, False, s["ridge"], s["minInstancesPerNode"], len(edges),
                    s["seed"], False,
                )
                for tree in grown:
                    tree.value *= s["stepSize"]
                trees += grown
                moved.unpersist()
        finally:
            table.unpersist()
        return GrownModel(trees, "softmax", start, classes)


def _gradients(trees: list[Tree], start: list[float]):
    def gradients(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if not frame.num_rows:
                continue
            rows = _matrix(frame.column("bins"))
            margins = np.tile(np.array(start), (len(rows), 1))
            for i, tree in enumerate(trees):
                margins[:, i % len(start)] += tree.value[tree.walk(rows, tree.cut), 0]
            chance, weight = _softmax(margins), frame.column("weight").to_numpy()[:, None]
            own = frame.column("label").to_numpy()[:, None] == np.arange(len(start))
            sums, masses = weight * (own - chance), weight * chance * (1 - chance)
            yield pa.RecordBatch.from_pydict({"bins": frame.column("bins"), "sums": _lists(sums), "masses": _lists(masses)})

    return gradients
