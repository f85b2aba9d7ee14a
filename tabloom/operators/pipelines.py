"""Feature assembly, member scores, votes and outcomes as pipeline stages that can be written and read.

With MLlib's fitted models between them they make one `PipelineModel`: it is saved, loaded in any session and applied
to a table in one pass. A stage keeps its state (figures, label tables) as Parquet beside its metadata.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.encode import CategoryIndex, FeatureAssembly


def _write_json(spark: SparkSession, path: str, value) -> None:
    spark.range(1).select(F.lit(json.dumps(value)).alias("value")).coalesce(1).write.parquet(path)


def _read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.parquet(path).first()["value"])


class _StageWriter(MLWriter):
    def __init__(self, stage: "Stage"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.write_state(self.sparkSession, f"{path}/state")


class _StageReader(MLReader):
    def __init__(self, cls: type["Stage"]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "Stage":
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return self.cls.read_state(self.sparkSession, f"{path}/state")._resetUid(metadata["uid"])


class Stage(Transformer, MLReadable, MLWritable):
    """A transformer with a state of its own: subclasses say how to write and read it."""

    def write(self) -> MLWriter:
        return _StageWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StageReader(cls)

    def write_state(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "Stage":
        raise NotImplementedError


class AssemblyStage(Stage):
    """Columns to one feature vector."""

    def __init__(self, assembly: FeatureAssembly, name: str = "features"):
        super().__init__()
        self.assembly, self.name = assembly, name

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.assembly.transform(dataset, self.name)

    def write_state(self, spark: SparkSession, path: str) -> None:
        self.assembly.save(spark, path)
        _write_json(spark, f"{path}/name", self.name)

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "AssemblyStage":
        return cls(FeatureAssembly.load(spark, path), _read_json(spark, f"{path}/name"))


def probabilities(probability: str | None, margin: str | None) -> Column:
    """Probability array from a column of probabilities, or from one-vs-rest margins turned into shares."""
    if probability is not None:
        return vector_to_array(probability)
    odds = F.transform(vector_to_array(margin), lambda x: 1 / (1 + F.exp(-2 * x)))
    total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
    return F.transform(odds, lambda x: x / total)


#: What MLlib's models add to a table.
_ADDED = ("prediction", "rawPrediction", "probability")


class ScoreStage(Stage):
    """The outcome of the model before it as one vector (class probabilities, or the prediction of a regressor), in place
    of the model's own columns, so that the next model can add the same ones."""

    def __init__(self, name: str):
        super().__init__()
        self.name = name

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if "probability" in dataset.columns or "rawPrediction" in dataset.columns:
            score = probabilities("probability" if "probability" in dataset.columns else None, "rawPrediction")
        else:
            score = F.array("prediction")
        return dataset.withColumn(self.name, array_to_vector(score)).drop(*_ADDED)

    def write_state(self, spark: SparkSession, path: str) -> None:
        _write_json(spark, path, self.name)

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "ScoreStage":
        return cls(_read_json(spark, path))


class StackStage(Stage):
    """The scores of a layer behind the features of the next one."""

    def __init__(self, scores: list[str], features: str = "features"):
        super().__init__()
        self.scores, self.features = scores, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        wide = VectorAssembler(inputCols=[self.features, *self.scores], outputCol="_stacked").transform(dataset)
        return wide.drop(self.features, *self.scores).withColumnRenamed("_stacked", self.features)

    def write_state(self, spark: SparkSession, path: str) -> None:
        _write_json(spark, path, {"scores": self.scores, "features": self.features})

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "StackStage":
        return cls(**_read_json(spark, path))


class VoteStage(Stage):
    """Weighted mean of the members' scores, and the class with the highest one (the first on ties)."""

    def __init__(self, weights: dict[str, float], n_classes: int | None):
        super().__init__()
        self.weights, self.n_classes = weights, n_classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        total = sum(self.weights.values())
        scores = {c: vector_to_array(c) for c in self.weights}

        def mean(i: int) -> Column:
            terms = [F.get(scores[c], F.lit(i)) * F.lit(w / total) for c, w in self.weights.items()]
            return sum(terms[1:], terms[0])

        if self.n_classes is None:
            return dataset.withColumn("prediction", mean(0))
        voted = dataset.withColumn("proba", F.array(*[mean(i) for i in range(self.n_classes)]))
        best = F.array_position("proba", F.array_max("proba")) - 1
        return voted.withColumn("prediction", best.cast("double"))

    def write_state(self, spark: SparkSession, path: str) -> None:
        _write_json(spark, path, {"weights": self.weights, "n_classes": self.n_classes})

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "VoteStage":
        return cls(**_read_json(spark, path))


class OutcomeStage(Stage):
    """The prediction as the user sees it: class names for classes, numbers otherwise."""

    def __init__(self, labels: CategoryIndex | None, target: str, task: str, name: str = "Predictions"):
        super().__init__()
        self.labels, self.target, self.task, self.name = labels, target, task, name

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.labels is None:
            return dataset.withColumn(self.name, F.col("prediction"))
        return self.labels.decode(dataset, self.target, "prediction", self.name)

    def write_state(self, spark: SparkSession, path: str) -> None:
        named = self.labels is not None
        _write_json(spark, f"{path}/outcome", {"target": self.target, "task": self.task, "name": self.name, "named": named})
        if named:
            self.labels.table.write.parquet(f"{path}/labels")

    @classmethod
    def read_state(cls, spark: SparkSession, path: str) -> "OutcomeStage":
        state = _read_json(spark, f"{path}/outcome")
        labels = CategoryIndex([state["target"]], spark.read.parquet(f"{path}/labels")) if state.pop("named") else None
        return cls(labels, **state)


def apply_to(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    """The columns of `df` without the target, and the outcome."""
    outcome = pipeline.stages[-1]
    features = df.drop(outcome.target)
    return pipeline.transform(features).select(*[F.col(f"`{c}`") for c in features.columns], outcome.name)
