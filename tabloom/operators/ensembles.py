"""Weighted, blended and stacked ensembles that score new tables.

Fitting takes out-of-fold scores of every candidate, chooses weights on them and fits the members once more on all
rows. With several layers, the out-of-fold scores of a layer are features of the next one, next to the columns of the
table, so no candidate of a layer ever sees a score of a model that was fitted on the same row. The result is one
`PipelineModel` of assembly, members, score vectors and vote: scoring is a map over the table, without a shuffle, and
the ensemble is saved and loaded like any pipeline.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import models as M
from tabloom.operators.budget import Budget
from tabloom.operators.clean import drop_targets
from tabloom.operators.pipelines import AssemblyStage, OutcomeStage, ScoreStage, StackStage, VoteStage, apply_to
from tabloom.session import pin


class Ensemble:
    """A fitted ensemble: its pipeline, the weights of its last layer and the board of all candidates."""

    def __init__(self, pipeline: PipelineModel, weights: dict[str, float], board: DataFrame | None = None):
        self.pipeline, self.weights, self.board = pipeline, weights, board

    def predict(self, df: DataFrame) -> DataFrame:
        """The table without the target, and the (decoded) prediction."""
        return apply_to(self.pipeline, df)

    def member_scores(self, df: DataFrame) -> DataFrame:
        """The table without the target, a score array for each member of the last layer under its name, and the
        vote (`proba` for classes, `prediction`)."""
        features = drop_targets(df, self.pipeline.stages[-1].target)
        scored = PipelineModel(self.pipeline.stages[:-1]).transform(features)
        arrays = [vector_to_array(c).alias(n) for n, c in zip(self.weights, self.pipeline.stages[-2].weights)]
        vote = [c for c in ("proba", "prediction") if c in scored.columns]
        return scored.select(*[F.col(f"`{c}`") for c in features.columns], *arrays, *vote)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Ensemble":
        pipeline = PipelineModel.read().session(spark).load(path)
        return cls(pipeline, dict(pipeline.stages[-2].weights))


def wide_scores(oof: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per key with the label and a score array `m<i>` for each candidate."""
    columns = [F.first(F.when(F.col("model") == m, F.col("proba")), True).alias(f"m{i}") for i, m in enumerate(names)]
    return oof.groupBy(key).agg(F.first("label").alias("label"), *columns)


def stacked(encoded: DataFrame, oof: DataFrame, key: str, names: list[str], stage: StackStage) -> DataFrame:
    """The encoded table with the out-of-fold scores of all candidates behind its features."""
    columns = [array_to_vector(f"m{i}").alias(c) for i, c in enumerate(stage.scores)]
    return stage.transform(encoded.join(wide_scores(oof, key, names).select(key, *columns), key))


def equal_weights(board: DataFrame, n_select: int) -> dict[str, float]:
    """The same weight for the best candidates of a board."""
    best = board.where(F.col("rank") <= n_select).orderBy("rank").collect()
    return {r["model"]: 1.0 / len(best) for r in best}


def greedy_weights(oof: DataFrame, key: str, task: str, rounds: int) -> dict[str, float]:
    """Weights above zero of the greedy selection."""
    rows = M.weighted_ensemble(oof, key, task, rounds).collect()  # one a candidate
    return {r["model"]: r["weight"] for r in rows if r["weight"] > 0}


def fit_ensemble(
    df: DataFrame, target: str, key: str, task: str | None = None, include=None, layers: int = 1, weights: str = "greedy",
    rounds: int = 10, n_select: int = 3, k: int = 3, seed: int = M.SEED, metric: str | None = None, exclude_columns=None,
    class_weight: str | None = None, time_limit: float | None = None, makers: dict[str, M.Candidate] | None = None, **params,
) -> Ensemble:
    """Fit candidates, choose the weights of the last layer and return an ensemble that scores.

    `weights` is "greedy" (forward selection on the out-of-fold loss, candidates without weight are left out) or
    "equal" (a blend of the best `n_select` by `metric`). `makers` replaces the usual candidates. The limit in
    seconds covers the cross-validation of all layers; a layer that has no time left is not built.
    """
    if layers < 1:
        raise ValueError("an ensemble has at least one layer")
    if weights not in ("greedy", "equal"):
        raise ValueError("weights are 'greedy' or 'equal'")
    task, assembly, labels, encoded = M.prepare(df, target, task, key, exclude_columns, class_weight)
    own = makers or M.candidates_for(task, labels, include, class_weight=class_weight, **params)
    n_classes = None if labels is None else labels.table.count()
    limit, stages, names, oof = Budget(time_limit), [AssemblyStage(assembly)], [], None
    table = pin(encoded)
    for layer in range(1, layers + 1):
        if layer > 1:
            if limit.left() == 0:
                break
            # All candidates of the layer below become members whose scores feed this one.
            below = _members(M.fit_all(table, {n: own[n] for n in names}, seed), names, f"_l{layer}m")
            stack = StackStage([f"_l{layer}m{i}" for i in range(len(names))])
            stages += [*below, stack]
            table = pin(stacked(table, oof, key, names, stack))
        # Stored, as the plans of a layer would otherwise hold those of all layers below.
        oof = pin(M.cross_validate(table, key, own, task, k, seed, time_limit=limit.left()))
        names = [r["model"] for r in oof.select("model").distinct().orderBy("model").collect()]
    board = M.cv_leaderboard(oof, task, metric)
    chosen = equal_weights(board, n_select) if weights == "equal" else greedy_weights(oof, key, task, rounds)
    stages += _members(M.fit_all(table, {n: own[n] for n in chosen}, seed), list(chosen), "_m")
    stages.append(VoteStage({f"_m{i}": w for i, w in enumerate(chosen.values())}, n_classes))
    stages.append(OutcomeStage(labels, target, task))
    kept = df.sparkSession.createDataFrame(board.collect(), board.schema)  # one row a candidate
    return Ensemble(PipelineModel(stages), chosen, kept)


def _members(fitted: dict, names: list[str], prefix: str) -> list:
    """Stages that score the named models one after the other."""
    return [stage for i, n in enumerate(names) for stage in (fitted[n], ScoreStage(f"{prefix}{i}"))]
