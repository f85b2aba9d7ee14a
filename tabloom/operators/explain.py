"""Shapley attributions: exact for linear regressors, sampled for any other trained model."""

from __future__ import annotations

import random

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import literal, ref
from tabloom.operators.models import TrainedModel
from tabloom.operators.split import bounded_sample

BACKGROUND_ROWS = 100


def explain_rows(
    model: TrainedModel, train: DataFrame, rows: DataFrame, key: str, features: list[str], rounds: int | None = None,
    max_rows: int | None = None, background_rows: int | None = None, seed: int = 42, class_index: int = 1,
) -> DataFrame:
    """(key, feature, attribution): mean change of the model value when a feature joins in random order.

    Where neither `background_rows` nor `rounds` is set, a linear regressor without text columns is explained
    exactly against all training rows (see `explain_linear`). Otherwise the background is a seeded sample of
    `background_rows` training rows (100 unless set), one a round unless `rounds` says
    otherwise: more rounds cost more and estimate better. All of `rows` are explained; with `max_rows` a seeded
    sample of them, as a short report needs. Every (row, round, step) becomes one
    synthetic row, all of them are scored in a single transform, and a map-side combined sum gives the
    attributions.
    """
    if background_rows is None and rounds is None and is_linear(model):
        if max_rows is not None:
            rows = bounded_sample(rows.select(key, *features), ref(key), max_rows, seed)
        return explain_linear(model, train, rows, key, features)
    background_rows = BACKGROUND_ROWS if background_rows is None else background_rows
    back = bounded_sample(train.select(key, *features), ref(key), background_rows, seed).select(*features).collect()
    rounds = rounds or len(back)
    rng = random.Random(seed)
    target = rows.select(key, *features)
    if max_rows is not None:
        target = bounded_sample(target, ref(key), max_rows, seed)
    types = {f.name: f.dataType for f in target.schema}
    rounds_plan = []
    for r in range(rounds):
        order = features[:]
        rng.shuffle(order)
        base = back[r % len(back)]
        place = F.struct(*[F.lit(order.index(f)).alias(f) for f in features])
        values = F.struct(*[literal(base[f], types[f]).alias(f) for f in features])
        rounds_plan.append(F.struct(F.array(*[F.lit(f) for f in order]).alias("order"), place.alias("place"), values.alias("base")))
    planned = target.select(key, *features, F.explode(F.array(*rounds_plan)).alias("_p"))
    stepped = planned.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = stepped.select(
        key,
        F.col("_p.order").alias("_order"),
        "_s",
        *[F.when(F.col(f"_p.place.{f}") < F.col("_s"), ref(f)).otherwise(F.col(f"_p.base.{f}")).alias(f) for f in features],
    )
    valued = model.value(mixed, class_index)
    # The value at a step counts for the feature that joined there and against the one that joins next.
    gains = F.array(
        F.struct(F.get("_order", F.col("_s") - 1).alias("feature"), F.col("value").alias("v")),
        F.struct(F.get("_order", F.col("_s")).alias("feature"), (-F.col("value")).alias("v")),
    )
    parts = valued.select(key, F.inline(gains)).where(F.col("feature").isNotNull())
    return parts.groupBy(key, "feature").agg((F.sum("v") / rounds).alias("attribution"))


def is_linear(model: TrainedModel) -> bool:
    """Whether the model value is a weighted sum with one summand a column."""
    return isinstance(model.model, LinearRegressionModel) and not model.assembly.text


def explain_linear(model: TrainedModel, train: DataFrame, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Exact attributions of a linear regressor: coefficient x (encoded value - its mean over all training rows).

    The order in which features join does not matter for a sum, so no rows are sampled or multiplied: one
    aggregate over the training table, one pass over `rows`.
    """
    used = model.assembly.numeric + model.assembly.categorical
    names = [f for f in features if f in used]

    def encoded(df: DataFrame) -> DataFrame:
        return model.assembly.transform(df.select(key, *features), "_v").select(key, vector_to_array("_v").alias("_v"))

    at = {f: F.get("_v", F.lit(used.index(f))) for f in names}
    means = encoded(train).agg(F.count("*"), *[F.avg(at[f]) for f in names]).first()[1:]
    mean, weight = dict(zip(names, means)), dict(zip(used, model.model.coefficients.toArray().tolist()))
    # A column that the model does not use changes nothing.
    parts = [F.lit(weight[f]) * (at[f] - F.lit(mean[f])) if f in mean else F.lit(0.0) for f in features]
    pairs = [F.struct(F.lit(f).alias("feature"), v.cast("double").alias("attribution")) for f, v in zip(features, parts)]
    return encoded(rows).select(key, F.inline(F.array(*pairs)))


def explain_global(attributions: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    mean = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    return mean.orderBy(F.desc("mean_abs"), "feature")
