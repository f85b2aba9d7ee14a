"""Encoders with separate fit and transform: categories, scaling, vectors, and their composition."""

from __future__ import annotations

import json

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import is_missing, present, ref
from tabloom.operators.clean import Imputer, Targets, target_list
from tabloom.operators.ranks import SMALL_SIDE_ROWS, dense_index, join_lookup
from tabloom.operators.roles import column_roles
from tabloom.operators.tfidf import TfIdf


class CategoryIndex:
    """Sorted distinct values of each column numbered from 0, as a table (column, value, idx)."""

    def __init__(self, columns: list[str], table: DataFrame):
        self.columns = columns
        self.table = table

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], *more: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> "CategoryIndex":
        """Fit on one table, or on the union of several (labels that only the test table has)."""
        values = None
        for part in (df, *more):
            pairs = part.select(
                F.inline(
                    F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value")) for c in columns])
                )
            )
            values = pairs if values is None else values.unionByName(pairs)
        distinct = values.where(F.col("value").isNotNull()).distinct()
        ranked = dense_index(distinct, ["column"], [F.col("value")], "idx", max_rows)
        return cls(columns, ranked.withColumn("idx", F.col("idx") - 1))

    def lookup(self, column: str) -> DataFrame:
        rows = self.table.where(F.col("column") == column)
        return rows.select(F.col("value").alias("_value"), F.col("idx").alias("_idx"))

    def transform(self, df: DataFrame, unseen: int | None = -1, suffix: str = "") -> DataFrame:
        """Replace each column by its number (or add `column + suffix`); unknown values get `unseen`."""
        out = df
        for c in self.columns:
            if c not in df.columns:
                continue
            joined = join_lookup(out, self.lookup(c), ref(c).cast("string") == F.col("_value"), "left")
            number = F.col("_idx") if unseen is None else F.coalesce("_idx", F.lit(unseen).cast("long"))
            out = joined.withColumn(c + suffix, number).drop("_value", "_idx")
        return out

    def decode(self, df: DataFrame, column: str, number: str, name: str) -> DataFrame:
        """Number back to the label when it is one of 0..k-1, else its text unchanged."""
        joined = join_lookup(df, self.lookup(column), ref(number).try_cast("long") == F.col("_idx"), "left")
        return joined.withColumn(name, F.coalesce("_value", ref(number).cast("string"))).drop("_value", "_idx")


def label_encode(train: DataFrame, test: DataFrame, target: str) -> tuple[CategoryIndex, DataFrame, DataFrame]:
    """Numbers for the target; when the test table has unseen labels the numbering covers both tables."""
    index = CategoryIndex.fit(train, [target])
    known = index.lookup(target)
    unseen = test.where(ref(target).isNotNull()).select(ref(target).cast("string").alias("_value")).distinct()
    if not unseen.join(known, "_value", "left_anti").isEmpty():
        index = CategoryIndex.fit(train, [target], test)
    return index, index.transform(train, None), index.transform(test, None)


class Scaler:
    """Linear scaling (x - shift) / scale with figures fitted in one scan."""

    def __init__(self, shift: dict[str, float], scale: dict[str, float]):
        self.shift = shift
        self.scale = scale

    @classmethod
    def standard(cls, df: DataFrame, columns: list[str]) -> "Scaler":
        """Mean and population deviation; a constant column is divided by 1."""
        return cls._fit(df, columns, F.avg, F.stddev_pop)

    @classmethod
    def minmax(cls, df: DataFrame, columns: list[str]) -> "Scaler":
        """Minimum and range; a constant column becomes 0."""
        return cls._fit(df, columns, F.min, lambda c: F.max(c) - F.min(c))

    @classmethod
    def _fit(cls, df: DataFrame, columns: list[str], shift, scale) -> "Scaler":
        if not columns:
            return cls({}, {})
        aggs: list[Column] = []
        for i, c in enumerate(columns):
            v = present(df, c).cast("double")
            aggs += [shift(v).alias(f"a{i}"), scale(v).alias(f"b{i}")]
        row = df.agg(*aggs).first()
        shifts = {c: row[f"a{i}"] if row[f"a{i}"] is not None else 0.0 for i, c in enumerate(columns)}
        return cls(shifts, {c: row[f"b{i}"] or 1.0 for i, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (ref(c).cast("double") - F.lit(self.shift[c])) / F.lit(self.scale[c]) for c in self.shift}
        return df.withColumns({c: v for c, v in scaled.items() if c in df.columns}) if scaled else df


def vector_from_array(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    """array<float> column as an ML vector."""
    return df.withColumn(name, array_to_vector(ref(column).cast("array<double>")))


def pca(df: DataFrame, vector: str, k: int, name: str = "components"):
    """Principal components of a vector column; returns the fitted model and the table with the scores."""
    model = PCA(k=k, inputCol=vector, outputCol=name).fit(df)
    return model, model.transform(df)


class FeatureAssembly:
    """Columns by role into one vector: medians and scaling, ordinal categories, weighted terms.

    Everything is fitted on the training table; other columns are dropped from the vector.
    """

    def __init__(self, numeric, categorical, text, imputer, scaler, categories, tfidf):
        self.numeric, self.categorical, self.text = numeric, categorical, text
        self.imputer, self.scaler, self.categories, self.tfidf = imputer, scaler, categories, tfidf

    @classmethod
    def fit(
        cls, train: DataFrame, target: Targets = None, text_columns: list[str] | None = None, scaling: str = "standard",
        max_features: int = 500, ngram_range: tuple[int, int] = (1, 2), exclude: list[str] | None = None,
    ) -> "FeatureAssembly":
        features = train.drop(*target_list(target), *(exclude or []))
        roles = {r["column"]: r["role"] for r in column_roles(features, None, text_columns).collect()}
        by_role = {role: [c for c in features.columns if roles.get(c) == role] for role in ("numeric", "categorical", "text")}
        imputer = Imputer.fit(features)
        filled = imputer.transform(features)
        fit_scaler = Scaler.standard if scaling == "standard" else Scaler.minmax
        scaler = fit_scaler(filled, by_role["numeric"])
        categories = CategoryIndex.fit(filled, by_role["categorical"]) if by_role["categorical"] else None
        tfidf = {c: TfIdf.fit(filled, c, max_features, ngram_range) for c in by_role["text"]}
        return cls(by_role["numeric"], by_role["categorical"], by_role["text"], imputer, scaler, categories, tfidf)

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        """The table with its columns as they were, plus the vector."""
        used = self.numeric + self.categorical + self.text
        work = df.withColumns({f"_f_{c}": ref(c) for c in used})
        inner = work.select(*[F.col(c) for c in work.columns])
        for c in self.numeric:
            median = self.imputer.medians.get(c)
            value = F.coalesce(F.when(~is_missing(df, c), F.col(f"_f_{c}").cast("double")), F.lit(median).cast("double"))
            scaled = (value - F.lit(self.scaler.shift[c])) / F.lit(self.scaler.scale[c])
            inner = inner.withColumn(f"_f_{c}", F.coalesce(scaled, F.lit(0.0)))
        for c in self.categorical:
            side = self.categories.lookup(c)
            joined = join_lookup(inner, side, F.coalesce(F.col(f"_f_{c}").cast("string"), F.lit("")) == F.col("_value"), "left")
            inner = joined.withColumn(f"_f_{c}", F.coalesce("_idx", F.lit(-1)).cast("double")).drop("_value", "_idx")
        for c in self.text:
            inner = self.tfidf[c].transform(inner, f"_f_{c}", f"_f_{c}")
        assembled = VectorAssembler(inputCols=[f"_f_{c}" for c in used], outputCol=name).transform(inner)
        return assembled.drop(*[f"_f_{c}" for c in used])

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {
            "numeric": self.numeric, "categorical": self.categorical, "text": self.text,
            "medians": self.imputer.medians, "strings": self.imputer.strings,
            "shift": self.scaler.shift, "scale": self.scaler.scale,
            "tfidf": {c: m.to_dict() for c, m in self.tfidf.items()},
        }
        spark.range(1).select(F.lit(json.dumps(meta)).alias("meta")).write.mode("overwrite").parquet(f"{path}/meta")
        if self.categories is not None:
            self.categories.table.write.mode("overwrite").parquet(f"{path}/categories")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureAssembly":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        categories = None
        if meta["categorical"]:
            categories = CategoryIndex(meta["categorical"], spark.read.parquet(f"{path}/categories"))
        return cls(
            meta["numeric"], meta["categorical"], meta["text"], Imputer(meta["medians"], meta["strings"]),
            Scaler(meta["shift"], meta["scale"]), categories, {c: TfIdf(**m) for c, m in meta["tfidf"].items()},
        )
