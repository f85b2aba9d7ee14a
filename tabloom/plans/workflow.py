"""End-to-end training and scoring runs built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.operators import models as M
from tabloom.operators.clean import drop_null_target, union_train_valid
from tabloom.operators.ensembles import Ensemble, fit_ensemble
from tabloom.operators.split import chronological_split, random_split


def rank_candidates(
    df: DataFrame, target: str, key: str, task: str | None = None, include=None, exclude_columns=None, folds: int = 3, **params
) -> DataFrame:
    """Prepare, cross-validate every candidate family and return the leaderboard."""
    task, _, labels, encoded = M.prepare(df, target, task, key, exclude_columns)
    makers = M.candidates_for(task, labels, include, **params)
    return M.cv_leaderboard(M.cross_validate(encoded, key, makers, task, folds), task)


def encode_truth(assembly, labels, df: DataFrame, target: str) -> DataFrame:
    """label and features of a table that no figure was fitted on; classes that training did not have become -1."""
    if labels is None:
        truth = df.withColumn("label", ref(target).cast("double"))
    else:
        truth = labels.transform(df.withColumn("_y", ref(target)), None).withColumn("label", ref(target).cast("double"))
    known = truth.withColumn("label", F.coalesce("label", F.lit(-1.0))) if labels is not None else truth
    return assembly.transform(known).select("label", "features")


def scores_on(fitted: dict, features: DataFrame, task: str) -> DataFrame:
    """Predictions (model, label, prediction, proba) of every fitted candidate on an encoded table."""
    scored = None
    for name, model in fitted.items():
        own = model.transform(features)
        proba = M.class_probabilities(own) if task == "classification" else F.array(F.col("prediction"))
        one = own.select(F.lit(name).alias("model"), "label", "prediction", proba.alias("proba"))
        scored = one if scored is None else scored.unionByName(one)
    return scored


def holdout_scores(df: DataFrame, target: str, key: str, task: str | None = None, include=None, test_pct: int = 20, **params) -> DataFrame:
    """Fit every candidate on the training part of an exact random split and score the test part."""
    parted = random_split(df, ref(key), test_pct)
    train = parted.where("split = 'train'").drop("split")
    test = parted.where("split = 'test'").drop("split")
    task, assembly, labels, encoded = M.prepare(train, target, task, key)
    makers = M.candidates_for(task, labels, include, **params)
    rows = df.count()
    fitted = M.fit_all(M.fit_rows(encoded, key, rows).cache(), makers, rows=rows * (100 - test_pct) // 100)
    # A class that only the test part has counts as wrong for every model.
    return M.group_scores(scores_on(fitted, encode_truth(assembly, labels, test, target).cache(), task), ["model"], task)


def train_validated(
    train: DataFrame, valid: DataFrame, target: str, key: str, task: str | None = None, include=None, metric: str | None = None,
    class_weight: str | None = None, time_limit: float | None = None, refit: bool = True, **params,
) -> tuple[M.TrainedModel, DataFrame]:
    """Fit every candidate on one table, choose by its score on another, and return the best model and the board.

    All figures of the assembly come from the training table. With `refit` the chosen family is fitted once more on
    both tables. With a limit in seconds, candidates that are not fitted by then are left out.
    """
    task, assembly, labels, encoded = M.prepare(train, target, task, key, class_weight=class_weight)
    encoded = M.fit_rows(encoded, key, train.count()).cache()
    makers = M.candidates_for(task, labels, include, class_weight=class_weight, **params)
    fitted = M.fit_all(encoded, makers, time_limit=time_limit)
    checked = scores_on(fitted, encode_truth(assembly, labels, drop_null_target(valid, target), target).cache(), task)
    board = M.cv_leaderboard(checked.withColumn("fold", F.lit(0)), task, metric).drop("std").cache()
    best = board.orderBy("rank").first()["model"]
    encoded.unpersist()
    if not refit:
        return M.TrainedModel(assembly, fitted[best], labels, target, task), board
    both = union_train_valid(train, valid)
    return M.train(both, target, key, best, task, class_weight=class_weight, **params), board


def train_chronological(df: DataFrame, time: str, target: str, key: str, valid_pct: int = 20, **options) -> tuple[M.TrainedModel, DataFrame]:
    """`train_validated` with the last rows by time as the validation table."""
    parted = chronological_split(df, time, key, valid_pct)
    train, valid = (parted.where(F.col("split") == s).drop("split", time) for s in ("train", "test"))
    return train_validated(train, valid, target, key, **options)


def tune_and_blend(df: DataFrame, target: str, key: str, task: str | None = None, time_limit: float | None = None, n_iter=None, **params) -> DataFrame:
    """Compare, tune the best family, blend it with the runners-up; scores of the blend and its members.

    The tuned model takes the place of the best one in the blend.
    """
    task, _, labels, encoded = M.prepare(df, target, task, key)
    encoded = encoded.cache()
    makers = M.candidates_for(task, labels, **params)
    oof = M.cross_validate(encoded, key, makers, task)
    _, best = M.compare_models(oof, task)
    searched, _, winner, _, _ = M.search(encoded, key, best[0], makers[best[0]], task, time_limit, n_iter=n_iter)
    members = searched.where(F.col("model") == winner).unionByName(oof.where(F.col("model").isin(best[1:])))
    votes = M.blend(members, key, labels.table.count() if labels is not None else None)
    truth = members.groupBy(key).agg(F.first("label").alias("label"))
    blended = votes.join(truth, key).select(F.lit("blend").alias("model"), "label", "prediction")
    return M.group_scores(members.select("model", "label", "prediction").unionByName(blended), ["model"], task)


def tuned_blend(
    df: DataFrame, target: str, key: str, task: str | None = None, time_limit: float | None = None, n_iter=None, n_select: int = 3,
    **params,
) -> Ensemble:
    """Compare, tune the best family and return a blend of it and the runners-up that scores new tables."""
    task, _, labels, encoded = M.prepare(df, target, task, key)
    encoded = encoded.cache()
    makers = M.candidates_for(task, labels, **params)
    _, best = M.compare_models(M.cross_validate(encoded, key, makers, task), task, n_select=n_select)
    _, _, winner, tuned, _ = M.search(encoded, key, best[0], makers[best[0]], task, time_limit, n_iter=n_iter)
    encoded.unpersist()
    members = {winner: tuned, **{n: makers[n] for n in best[1:]}}
    return fit_ensemble(df, target, key, task, weights="equal", n_select=n_select, makers=members)
