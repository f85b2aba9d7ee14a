"""Listwise learning to rank: boosted trees on gradients weighted by the change of NDCG.

A pair of rows of a group pulls them apart by as much as swapping them would change the group's NDCG at `depth`. Beyond
that depth places count nothing, so only pairs with one of the first `depth` rows matter: each group is reduced to that
short list, every row of the group meets the list once, a batch of rows at a time, and what the list's rows receive is
summed up per batch and task before it is shuffled. So a group costs its rows times `depth`, not their square, and a group with a third of all rows is spread
over all tasks. Each round fits one distributed regression tree on gradient over curvature, weighted by the curvature,
which gives leaves their Newton step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tabloom.operators.models import SEED, prepare
from tabloom.operators.pipelines import AssemblyStage, Stage, _read_json, _write_json
from tabloom.operators.ranks import join_lookup
from tabloom.session import pin


class SumStage(Stage):
    """A weighted sum of columns, which are dropped."""

    def __init__(self, columns: list[str], weight: float, name: str):
        super().__init__()
        self.columns, self.weight, self.name = columns, weight, name

    def _transform(self, dataset: DataFrame) -> DataFrame:
        total = sum((F.col(c) for c in self.columns), F.lit(0.0))
        return dataset.withColumn(self.name, total * self.weight).drop(*self.columns)

    def write_state(self, spark: SparkSession, path: str) -> None:
        _write_json(spark, path, {"columns": self.columns, "weight": self.weight, "name": self.name})

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "SumStage":
        return cls(**_read_json(spark, path))


def _gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1


def _discount(place: Column) -> Column:
    return 1 / F.log2(place + 1.0)


def ideal_gains(rows: DataFrame, depth: int) -> DataFrame:
    """Largest possible DCG at `depth` of each group; groups without any relevance are left out."""
    best = rows.withColumn("_n", F.row_number().over(W.partitionBy("_group").orderBy(F.desc("label")))).where(F.col("_n") <= depth)
    ideal = best.groupBy("_group").agg(F.sum(_gain(F.col("label")) * _discount(F.col("_n"))).alias("_ideal"))
    return ideal.where("_ideal > 0")


#: Shares of listed rows that a task holds back.
HELD_ROWS = 1_000_000


def _pair_sums(frame: pa.RecordBatch, depth: int) -> list[pa.RecordBatch]:
    """_key, _pull and _bend of the rows of a batch, and those that they give to the listed rows of their groups."""
    label, score, ideal = (frame.column(c).to_numpy() for c in ("label", "score", "_ideal"))
    place = frame.column("_place").to_numpy()
    lists = frame.column("_keys")
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    start, size, keys = ends[:-1], np.diff(ends), lists.flatten()
    labels, scores = (frame.column(c).flatten().to_numpy() for c in ("_labels", "_scores"))
    group = frame.column("_of").dictionary_encode().indices.to_numpy()
    _, first = np.unique(group, return_index=True)  # groups are numbered as they come, so these are their first rows
    cut, gain = np.where(place > 0, 1 / np.log2(np.maximum(place, 1) + 1.0), 0.0), np.exp2(label) - 1
    pull, bend = np.zeros(len(label)), np.zeros(len(label))
    given = []
    # One listed row of every group at a time. Pairs of two listed rows are met from both sides already; of the others
    # the listed row gets its share here.
    for i in range(int(min(depth, size.max()))):
        rows = np.flatnonzero(size > i)
        at = start[rows] + i
        other, own = labels[at], label[rows]
        side = np.sign(own - other)
        with np.errstate(over="ignore"):
            chance = 1 / (1 + np.exp(side * (score[rows] - scores[at])))
        worth = np.abs(gain[rows] - (np.exp2(other) - 1)) * np.abs(cut[rows] - 1 / np.log2(i + 2.0)) / ideal[rows]
        worth = np.where(own != other, worth, 0.0)
        pulls, bends = side * chance * worth, chance * (1 - chance) * worth
        pull[rows] += pulls
        bend[rows] += bends
        theirs = (place[rows] == 0) & (own != other)
        to = group[rows][theirs]
        met = np.flatnonzero(np.bincount(to, minlength=len(first)))
        sums = (np.bincount(to, weights=w[theirs], minlength=len(first))[met] for w in (-pulls, bends))
        given.append((start[first[met]] + i, *sums))
    at, down, curve = (np.concatenate(c) for c in zip(*given))
    columns = [(frame.column("_key"), pull, bend), (keys.take(pa.array(at)), down, curve)]
    # A sum over no rows comes as whole numbers.
    return [pa.RecordBatch.from_arrays([k, *(pa.array(x.astype(float)) for x in (p, c))], ["_key", "_pull", "_bend"]) for k, p, c in columns]


def pair_gradients(scored: DataFrame, ideal: DataFrame, depth: int) -> DataFrame:
    """_key, _pull and _bend (gradient and curvature) of every row from its pairs; `scored` has _key, _group, label
    and score, one row a key, and is stored."""
    first = F.row_number().over(W.partitionBy("_group").orderBy(F.desc("score"), "_key"))
    top = scored.withColumn("_place", first).where(F.col("_place") <= depth)
    lists = top.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_place", "_key", "label", "score"))).alias("_top"))  # `depth` a group
    lists = lists.join(ideal, "_group").select(
        F.col("_group").alias("_of"), F.col("_top._key").alias("_keys"), F.col("_top.label").alias("_labels"),
        F.col("_top.score").alias("_scores"), "_ideal",
    )
    met = join_lookup(scored, lists, F.col("_group") == F.col("_of"))
    met = met.select(
        "_key", "label", "score", F.array_position("_keys", F.col("_key")).alias("_place"), "_of", "_keys", "_labels", "_scores", "_ideal"
    )

    def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Shares of listed rows come last where they are few: the order of the rows, on which the samples of tree cuts
        # depend, then does not depend on the batches.
        held, count = [], 0
        for frame in frames:
            if frame.num_rows:
                own, theirs = _pair_sums(frame, depth)
                yield own
                held.append(theirs)
                count += theirs.num_rows
            if count > HELD_ROWS:
                yield from held
                held, count = [], 0
        yield from held

    fields = [scored.schema["_key"], T.StructField("_pull", T.DoubleType()), T.StructField("_bend", T.DoubleType())]
    parts = met.mapInArrow(sums, T.StructType(fields))
    return parts.groupBy("_key").agg(F.sum("_pull").alias("_pull"), F.sum("_bend").alias("_bend"))


class ListwiseModel:
    """A fitted ranker: assembly, trees and their sum as one pipeline."""

    def __init__(self, pipeline: PipelineModel):
        self.pipeline = pipeline

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """The table with the score, higher for better rows; a map without a shuffle."""
        scored = self.pipeline.transform(df)
        return scored.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_score").alias(name))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ListwiseModel":
        return cls(PipelineModel.read().session(spark).load(path))


def fit_listwise(
    df: DataFrame, key: str, group: str, relevance: str, rounds: int = 10, depth: int = 10, rate: float = 0.3, max_depth: int = 4,
    seed: int = SEED, **assembly,
) -> ListwiseModel:
    """Fit the ranker on rows with a unique key, a group and a relevance of 0 or more; `depth` is that of the NDCG.

    Rows without relevance are left out, as are groups in which all rows are equally relevant (they have no pairs).
    """
    _, features, _, encoded = prepare(df, relevance, "regression", key, [group], **assembly)
    groups = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{group}`").cast("string").alias("_group"))
    table = pin(encoded.select(F.col(f"`{key}`").alias("_key"), "label", "features").join(groups, "_key").where("_group is not null"))
    ideal = pin(ideal_gains(table, depth))
    scored = pin(table.select("_key", "_group", "label", F.lit(0.0).alias("score")))
    trees = []
    for number in range(rounds):
        pulls = pair_gradients(scored, ideal, depth).where("_bend > 1e-12")
        rows = table.join(pulls, "_key").select("features", (F.col("_pull") / F.col("_bend")).alias("step"), F.col("_bend").alias("weight"))
        rows = pin(rows)
        if rows.isEmpty():
            break
        tree = DecisionTreeRegressor(
            labelCol="step", weightCol="weight", maxDepth=max_depth, predictionCol=f"_t{number}", seed=seed
        ).fit(rows)
        trees.append(tree)
        moved = tree.transform(table.select("_key", "features")).select("_key", F.col(f"_t{number}").alias("_step"))
        scored = pin(scored.join(moved, "_key").withColumn("score", F.col("score") + rate * F.col("_step")).drop("_step"))
    names = [f"_t{i}" for i in range(len(trees))]
    return ListwiseModel(PipelineModel([AssemblyStage(features), *trees, SumStage(names, rate, "_score")]))
