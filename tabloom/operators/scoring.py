"""Scoring: decoded predictions, JSON payloads, most probable classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import ref
from tabloom.operators.encode import CategoryIndex
from tabloom.operators.models import TrainedModel


def predict_batch(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Drop the target if present, transform, append `Predictions`."""
    return model.predict(df)


def decode_predictions(scored: DataFrame, train: DataFrame, target: str, prediction: str = "Predictions") -> DataFrame:
    """Class numbers to labels when the training target is a string; numbers outside 0..k-1 stay as they are."""
    if target not in train.columns or not isinstance(train.schema[target].dataType, T.StringType):
        return scored
    if not isinstance(scored.schema[prediction].dataType, T.NumericType):
        return scored
    return CategoryIndex.fit(train, [target]).decode(scored, target, prediction, prediction)


def assigned_column(task: str, columns: list[str]) -> str:
    """Output column of an unsupervised or supervised scorer, by task."""
    wanted = {"Anomaly Detection": ["Anomaly", "Label"], "Clustering": ["Cluster", "Label"]}.get(task, ["prediction_label", "Label"])
    return next((c for c in [*wanted, "prediction_label", "Label"] if c in columns), columns[-1])


def parse_payloads(payloads: DataFrame, feature_schema: str, column: str = "payload") -> DataFrame:
    """JSON payloads to feature rows, for batch tables and streams alike.

    `{"data": [{...}, ...]}` gives one row per object, a single object gives one row, anything else one row
    with `error` set. `item` numbers the rows of a payload.
    """
    keep = [c for c in payloads.columns if c != column]
    text = ref(column)
    many = F.from_json(text, f"struct<data: array<struct<{feature_schema}>>>")
    single = F.from_json(text, f"struct<{feature_schema}>")
    has_data = F.array_contains(F.json_object_keys(text), "data")
    bad = F.json_object_keys(text).isNull() | (has_data & many["data"].isNull())
    rows = F.when(bad, F.array(F.lit(None).cast(f"struct<{feature_schema}>"))).when(has_data, many["data"]).otherwise(F.array(single))
    exploded = payloads.select(*keep, F.when(bad, "invalid payload").alias("error"), F.posexplode(rows).alias("item", "_row"))
    return exploded.select(*keep, "item", "error", "_row.*")


def score_payloads(model: TrainedModel, payloads: DataFrame, feature_schema: str, column: str = "payload") -> DataFrame:
    """Predictions for JSON payloads; rows of invalid payloads keep their error and get no prediction."""
    parsed = parse_payloads(payloads, feature_schema, column)
    scored = model.predict(parsed)
    return scored.withColumn("Predictions", F.when(F.col("error").isNull(), F.col("Predictions")))


def top_class(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Label with the highest score (the first on ties) and that score."""
    best = F.greatest(*[ref(s) for s in scores.values()])
    label = None
    for name, s in scores.items():
        hit = ref(s) == best
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return df.withColumns({"top_label": label, "top_score": best})
