"""Forests and boosted trees of regressors on tables of many rows, grown over blocks of small bin numbers.

MLlib's fits keep each row as objects and visit them once for every group of nodes. Here a row is a byte a feature and its
target, kept in blocks; a level of all trees of a fit is one job, whose tasks add the rows of a block to histograms with
a few vector operations a tree. What is shuffled depends on the model's size and the number of tasks, not on the rows; the driver
receives one histogram a tree. Settings mean what they mean to MLlib: cut points come from a sample of rows, bagging
draws Poisson weights, each node tries its own features and takes the split of most gain. The outcome is MLlib's own model.

The weights of a block are drawn from the seed and the block's place, as MLlib draws them by partition.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.grown import _matrix

#: Rows that are handled at once: their columns stay in a core's own cache.
BLOCK = 1 << 14
#: Histogram figures a task holds at once; a level with more open nodes takes several jobs.
CELLS = 4_000_000
#: A split has to gain more than this share of the node's squares, which is what sums of doubles can tell.
LEAST_GAIN = 1e-13
#: Draws of 16 bits, numbered by their Poisson weight.
DRAWS = 1 << 16

_STATE = "fold int, place bigint, x binary, y binary"


def node_features(strategy: str, width: int, n_trees: int) -> int | None:
    """Features that a node tries, or None for a strategy that is not known here."""
    if strategy == "auto":
        strategy = "all" if n_trees == 1 else "onethird"
    sizes = {
        "all": width, "onethird": math.ceil(width / 3), "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))),
    }
    return sizes.get(strategy)


def grows(estimator, table: DataFrame) -> bool:
    """Whether an estimator is one whose settings are all known here; what is not stays with MLlib."""
    if not isinstance(estimator, RandomForestRegressor | GBTRegressor):
        return False
    get = lambda name: estimator.getOrDefault(name)
    nominal = "nominal" in table.schema[get("featuresCol")].metadata.get("ml_attr", {}).get("attrs", {})
    if nominal or estimator.isSet("weightCol") or get("maxBins") > 256 or get("maxDepth") > 12 or get("minWeightFractionPerNode") > 0:
        return False
    if isinstance(estimator, GBTRegressor):
        return (
            get("lossType") == "squared" and get("subsamplingRate") == 1.0 and get("featureSubsetStrategy") == "all"
            and not estimator.isSet("validationIndicatorCol")
        )
    whole = get("bootstrap") or get("subsamplingRate") == 1.0
    return whole and node_features(get("featureSubsetStrategy"), 1, get("numTrees")) is not None


class Packed:
    """The blocks of a table with the columns `features` and `label` (and `fold`), made once for all fits on it."""

    def __init__(self, table: DataFrame, rows: int):
        self.table, self.rows = table, rows
        self.lock, self.made = threading.Lock(), {}

    def serves(self, estimator) -> bool:
        return estimator.getOrDefault("featuresCol") == "features" and estimator.getOrDefault("labelCol") == "label"

    def of(self, bins: int, seed: int) -> tuple[list[np.ndarray], float, DataFrame]:
        """Thresholds, mean target and blocks."""
        with self.lock:
            if (bins, seed) not in self.made:
                fold = F.col("fold") if "fold" in self.table.columns else F.lit(0)
                slim = self.table.select(fold.alias("fold"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
                points, centre = split_points(slim, self.rows, bins, seed)
                self.made[bins, seed] = points, centre, blocked(slim, points, centre)
            return self.made[bins, seed]

    def release(self) -> None:
        for _, _, blocks in self.made.values():
            blocks.unpersist()
        self.made.clear()


def fit(estimator, table: DataFrame, rows: int, packed: Packed | None = None, without: int | None = None):
    """A fitted estimator on a table of `rows` rows: stages of a pipeline one after the other, forests and boosted trees
    over blocks, all others as they fit themselves.

    `packed` holds the blocks of the table, or of one that has also the rows of the fold `without`; then thresholds are
    those of the whole table.
    """
    if isinstance(estimator, Pipeline):
        stages, models = estimator.getStages(), []
        for i, stage in enumerate(stages):
            models.append(fit(stage, table, rows) if hasattr(stage, "fit") else stage)
            if i + 1 < len(stages):
                table = models[-1].transform(table)
        return PipelineModel(models)
    if not grows(estimator, table):
        return estimator.fit(table)
    get = lambda name: estimator.getOrDefault(name)
    own = packed is None or not packed.serves(estimator)
    if own:
        packed, without = Packed(table.select(F.col(get("featuresCol")).alias("features"), F.col(get("labelCol")).alias("label")), rows), None
    try:
        points, centre, blocks = packed.of(get("maxBins"), get("seed"))
        if without is not None:
            blocks = blocks.where(F.col("fold") != without)
        if isinstance(estimator, GBTRegressor):
            trees = boost(blocks, points, estimator)
            trees[0].move(centre)
        else:
            n_trees = get("numTrees")
            tries = node_features(get("featureSubsetStrategy"), len(points), n_trees)
            trees = grow(blocks, n_trees, points, estimator, tries, get("subsamplingRate") if get("bootstrap") else None)
            for tree in trees:
                tree.move(centre)
    finally:
        if own:
            packed.release()
    return mllib_model(estimator, trees, points, table.sparkSession)


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most `bins` - 1 thresholds between the values of a sample: all midpoints, or those nearest to even shares."""
    known, counts = np.unique(values, return_counts=True)
    middle = (known[:-1] + known[1:]) / 2
    if len(known) <= bins:
        return middle
    upto, stride, out = np.cumsum(counts), len(values) / bins, []
    target = stride
    for i in range(1, len(known)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def split_points(slim: DataFrame, rows: int, bins: int, seed: int) -> tuple[list[np.ndarray], float]:
    """Thresholds of each feature and a mean target, both from a sample of about max(bins^2, 10,000) rows as in MLlib."""
    size = max(bins * bins, 10_000)
    sample = (slim.sample(min(1.0, size / rows), seed) if rows > size else slim).toArrow()
    if not sample.num_rows:
        sample = pa.Table.from_batches(slim.limit(size).toArrow().to_batches(), sample.schema)
    if not sample.num_rows:
        raise ValueError("no rows to fit on")
    x = _matrix(sample.column("x").combine_chunks())
    return [cut_points(column, bins) for column in x.T], float(np.mean(sample.column("label").to_numpy()))


def blocked(slim: DataFrame, points: list[np.ndarray], centre: float) -> DataFrame:
    """Blocks of rows of one fold (fold, place, x, y) over a few tasks a core: bin numbers, a feature after the other, and
    distances of the target from a centre, which keeps squared sums small."""

    def packed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes, place = {}, TaskContext.get().partitionId() << 32

        def block(fold: int) -> pa.RecordBatch:
            """The first rows that are held of a fold."""
            x, y = (np.concatenate([part[i] for part in held[fold]], axis=-1) for i in (0, 1))
            held[fold], sizes[fold] = [(x[:, BLOCK:], y[BLOCK:])], max(0, len(y) - BLOCK)
            out = {"fold": pa.array([fold], pa.int32()), "place": pa.array([place], pa.int64())}
            return pa.RecordBatch.from_pydict(out | {n: pa.array([v.tobytes()], pa.binary()) for n, v in (("x", x[:, :BLOCK]), ("y", y[:BLOCK]))})

        for frame in frames:
            if not frame.num_rows:
                continue
            x = _matrix(frame.column("x"))
            if frame.column("label").null_count or not (np.isfinite(x).all() and np.isfinite(frame.column("label").to_numpy()).all()):
                raise ValueError("labels and features must be finite numbers")
            bins = np.stack([np.searchsorted(p, column, side="left").astype(np.uint8) for p, column in zip(points, x.T)])
            y, folds = frame.column("label").to_numpy() - centre, frame.column("fold").to_numpy()
            for fold in np.unique(folds).tolist():
                own = folds == fold
                held.setdefault(fold, []).append((bins[:, own], y[own]))
                sizes[fold] = sizes.get(fold, 0) + int(own.sum())
                while sizes[fold] >= BLOCK:
                    yield block(fold)
                    place += 1
        for fold in sorted(held):
            if sizes[fold]:
                yield block(fold)
                place += 1

    tasks = 3 * slim.sparkSession.sparkContext.defaultParallelism
    return slim.coalesce(tasks).mapInArrow(packed, _STATE).persist(StorageLevel.MEMORY_AND_DISK)


def _arrays(frame: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for place, x, y in zip(frame.column("place"), frame.column("x"), frame.column("y")):
        target = np.frombuffer(y.as_buffer(), dtype=np.float64)
        yield place.as_py(), np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(width, len(target)), target


class Grown:
    """A tree as a heap: the children of node i are 2i + 1 and 2i + 2. A leaf sends its rows on to the left, and its value
    stands for all nodes below it."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full(size, -1, dtype=np.int64)
        self.cut = np.full(size, 255, dtype=np.uint8)  # last bin that goes left
        self.value, self.gain = np.zeros(size), np.zeros(size)
        self.stats = np.zeros((size, 3))  # mass, sum and squares of the targets

    def walk(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node that each column of `x` comes to after some levels."""
        n = x.shape[1]
        at = np.zeros(n, dtype=np.int64)
        if levels and self.feature[0] < 0:
            return at + 2**levels - 1
        if levels:
            at += 1 + (x[self.feature[0]] > self.cut[0])
        flat, here, start = x.ravel(), np.arange(n), np.maximum(self.feature, 0) * n
        for _ in range(levels - 1):
            place = start.take(at)
            place += here
            right = flat.take(place) > self.cut.take(at)
            at *= 2
            at += 1
            at += right
        return at

    def settle(self) -> None:
        """Gives each node below a leaf the value of the leaf."""
        for i in range(len(self.feature) // 2):
            if self.feature[i] < 0:
                self.value[2 * i + 1] = self.value[2 * i + 2] = self.value[i]

    def move(self, by: float) -> None:
        """Targets that are `by` larger."""
        mass, total = self.stats[:, 0].copy(), self.stats[:, 1].copy()
        self.value += by
        self.stats[:, 1] += by * mass
        self.stats[:, 2] += 2 * by * total + by * by * mass


def poisson_weights(rate: float) -> np.ndarray:
    """Weight of each of the draws, in shares of a Poisson distribution."""
    term, ends, k = math.exp(-rate), [], 0
    total = term
    while total < 1 - 0.5 / DRAWS and k < 255:
        ends.append(total)
        k += 1
        term *= rate / k
        total += term
    return np.searchsorted(np.array(ends), (np.arange(DRAWS) + 0.5) / DRAWS, side="right").astype(np.uint8)


def _histograms(trees: list[Grown], opened: dict[int, list[tuple[int, np.ndarray]]], level: int, width: int, bins: int, figures: int, bag, seed: int):
    """Map of blocks to one histogram a tree: of its open nodes and their features mass and sum of targets a bin, and also
    the squares on the last level, whose children have no histogram of their own; then the squares of each node."""
    tries = len(next(iter(opened.values()))[0][1])
    # Rows of closed nodes are counted in a place of their own, which nobody reads.
    plans = {}
    for tree, nodes in opened.items():
        slot_of = np.full(2 ** (level + 1) - 1, len(nodes), dtype=np.int64)
        for slot, (node, _) in enumerate(nodes):
            slot_of[node] = slot
        plans[tree] = (slot_of, np.stack([f for _, f in nodes] + [np.zeros(tries, dtype=np.int64)]), len(nodes) + 1)
    drawn, n_trees = None if bag is None else poisson_weights(bag), len(trees)

    def cells(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {t: (np.zeros((slots, tries, figures, bins)), np.zeros(slots)) for t, (_, _, slots) in plans.items()}
        for frame in frames:
            for block, x, y in _arrays(frame, width):
                n, flat, here = len(y), x.ravel(), np.arange(len(y))
                if drawn is not None:
                    chance = np.random.Generator(np.random.SFC64([seed, block]))
                    draws = chance.integers(0, DRAWS, size=(n_trees, n), dtype=np.uint16)
                for t, (slot_of, wanted, slots) in plans.items():
                    if drawn is None:
                        mass, own = None, y
                    else:
                        mass = drawn.take(draws[t]).astype(np.float64)
                        own = mass * y
                    slot = slot_of.take(trees[t].walk(x, level))
                    sums, squares = held[t]
                    square = own * y
                    squares += np.bincount(slot, square, slots)
                    start = slot * bins
                    for j in range(tries):
                        # One feature for all nodes is a column as it lies there.
                        seen = x[wanted[0, j]] if tries == width else flat.take((wanted[:, j] * n).take(slot) + here)
                        index = start + seen
                        for i, weights in enumerate((mass, own, square)[:figures]):
                            sums[:, j, i] += np.bincount(index, weights, slots * bins).reshape(slots, bins)
        for t, (sums, squares) in held.items():
            both = np.concatenate([sums[:-1].ravel(), squares[:-1]])
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "cells": pa.array([both.tobytes()], pa.binary())})

    return cells


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), dtype=np.float64) for c in table.column("cells"))
    return pa.table({"tree": table.column("tree").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})


def best_split(sums: np.ndarray, squares: float, features: np.ndarray, points: list[np.ndarray], least: int, least_gain: float):
    """The node's figures (mass, sum, squares), and the split of most gain as (gain, feature, bin, left figures), if any."""
    mass, total = sums[0, 0].sum(), sums[0, 1].sum()
    node = np.array([mass, total, squares])
    sides = np.cumsum(sums, axis=2)
    left, sent = sides[:, 0], sides[:, 1]
    rest = mass - left
    limits = np.array([len(points[f]) for f in features])
    allowed = (np.arange(left.shape[1]) < limits[:, None]) & (left >= max(least, 1)) & (rest >= max(least, 1))
    if not allowed.any():
        return node, None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, sent**2 / left + (total - sent) ** 2 / rest - total**2 / mass, -np.inf)
    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[j, b] <= LEAST_GAIN * squares or gain[j, b] / mass < least_gain:
        return node, None
    return node, (gain[j, b] / mass, int(features[j]), int(b), sides[j, :, b])


def grow(blocks: DataFrame, n_trees: int, points: list[np.ndarray], estimator, tries: int, bag: float | None, number: int = 0) -> list[Grown]:
    """Trees grown side by side, a job a level; `bag` is the rate of Poisson weights, or None for all rows as they are."""
    get = lambda name: estimator.getOrDefault(name)
    depth, seed, width = get("maxDepth"), get("seed") & (2**63 - 1), len(points)
    bins = max(len(p) for p in points) + 1
    trees = [Grown(depth) for _ in range(n_trees)]
    open_nodes = [(t, 0) for t in range(n_trees)]
    at_once = max(1, CELLS // (tries * 3 * bins))
    for level in range(max(1, depth)):
        shown = 3 if level + 1 >= depth else 2
        found, after = [], []
        for start in range(0, len(open_nodes), at_once):
            opened: dict[int, list[tuple[int, np.ndarray]]] = {}
            for t, node in open_nodes[start : start + at_once]:
                chance = np.random.default_rng([seed, number, t, node])
                chosen = np.arange(width) if tries == width else np.sort(chance.choice(width, tries, replace=False))
                opened.setdefault(t, []).append((node, chosen))
            cells = _histograms(trees, opened, level, width, bins, shown, bag, seed)
            partial = blocks.mapInArrow(cells, "tree int, cells binary")
            for row in partial.groupBy("tree").applyInArrow(_added, "tree int, cells binary").collect():  # one row a tree
                figures = np.frombuffer(row["cells"], dtype=np.float64)
                nodes = opened[row["tree"]]
                sums = figures[: -len(nodes)].reshape(len(nodes), tries, shown, bins)
                found += [(row["tree"], node, f, sums[i], figures[len(figures) - len(nodes) + i]) for i, (node, f) in enumerate(nodes)]
        for t, node, features, sums, squares in sorted(found, key=lambda x: x[:2]):
            tree = trees[t]
            tree.stats[node], best = best_split(sums, squares, features, points, get("minInstancesPerNode"), get("minInfoGain"))
            mass, total, _ = tree.stats[node]
            tree.value[node] = total / mass if mass else 0.0
            if best is None or depth == 0:
                continue
            tree.gain[node], tree.feature[node], tree.cut[node], left = best
            for child, side in ((2 * node + 1, left), (2 * node + 2, tree.stats[node][:shown] - left)):
                tree.stats[child, :shown] = side
                tree.value[child] = side[1] / side[0]
                if level + 1 < depth:
                    after.append((t, child))
        open_nodes = after
        if not open_nodes:
            break
    for tree in trees:
        tree.settle()
    return trees


def boost(blocks: DataFrame, points: list[np.ndarray], estimator) -> list[Grown]:
    """Trees one after the other, each on twice what those before it leave of the target (the gradient of the squares)."""
    width, trees, rest = len(points), [], blocks
    for number in range(estimator.getOrDefault("maxIter")):
        before = rest
        if number == 1:
            rest = before.mapInArrow(_left(trees[-1], 1.0, 2.0, width), _STATE).persist(StorageLevel.MEMORY_AND_DISK)
        elif number:
            rest = before.mapInArrow(_left(trees[-1], 2.0 * estimator.getOrDefault("stepSize"), 1.0, width), _STATE)
            rest = rest.persist(StorageLevel.MEMORY_AND_DISK)
        trees += grow(rest, 1, points, estimator, width, None, number)
        if before is not rest and before is not blocks:
            before.unpersist()
    if rest is not blocks:
        rest.unpersist()
    return trees


def _left(tree: Grown, weight: float, scale: float, width: int):
    """Map of blocks to what a tree with some weight leaves of the targets, times a scale."""
    value = tree.value * weight

    def left(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rest = [((y - value.take(tree.walk(x, tree.depth))) * scale).tobytes() for _, x, y in _arrays(frame, width)]
            same = {n: frame.column(n) for n in ("fold", "place", "x")}
            yield pa.RecordBatch.from_pydict(same | {"y": pa.array(rest, pa.binary())})

    return left


def mllib_model(estimator, trees: list[Grown], points: list[np.ndarray], spark: SparkSession):
    """The trees as a fitted model of MLlib's, with the estimator's columns and settings."""
    gateway = spark.sparkContext._gateway
    ml, calculator = gateway.jvm.org.apache.spark.ml, gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def doubles(values):
        out = gateway.new_array(gateway.jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def node(tree: Grown, i: int):
        mass, total, squares = (float(v) for v in tree.stats[i])
        mean = total / mass if mass else 0.0
        impurity = max(0.0, squares / mass - mean * mean) if mass else 0.0
        stats = calculator(doubles((mass, total, squares)), round(mass))
        if tree.feature[i] < 0:
            return ml.tree.LeafNode(float(tree.value[i]), impurity, stats)
        f = int(tree.feature[i])
        split = ml.tree.ContinuousSplit(f, float(points[f][tree.cut[i]]))
        sides = node(tree, 2 * i + 1), node(tree, 2 * i + 2)
        return ml.tree.InternalNode(float(tree.value[i]), impurity, float(tree.gain[i]), *sides, split, stats)

    one = ml.regression.DecisionTreeRegressionModel
    members = gateway.new_array(one, len(trees))
    for i, tree in enumerate(trees):
        members[i] = one(node(tree, 0), len(points))
    if isinstance(estimator, GBTRegressor):
        weights = doubles([1.0] + [estimator.getOrDefault("stepSize")] * (len(trees) - 1))
        model = GBTRegressionModel(ml.regression.GBTRegressionModel(estimator.uid, members, weights, len(points)))
    else:
        model = RandomForestRegressionModel(ml.regression.RandomForestRegressionModel(estimator.uid, members, len(points)))
    return estimator._copyValues(model)
