"""Weighted terms of a text column.

Fitting counts terms over the whole corpus and keeps the most frequent ones; weighting is a row-wise
projection, so no text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.functions.fixed import STOP_WORDS
from tabloom.functions.text import ngrams, tokens
from tabloom.session import spread


class TfIdf:
    """Top terms by corpus count (ties by term), weight tf * (ln((1 + n) / (1 + df)) + 1), unit length per row."""

    def __init__(self, vocabulary, idf, ngram_range=(1, 2), stop_words=None):
        self.vocabulary = list(vocabulary)
        self.idf = list(idf)
        self.ngram_range = tuple(ngram_range)
        self.stop_words = STOP_WORDS if stop_words is None else list(stop_words)

    def to_dict(self) -> dict:
        return {
            "vocabulary": self.vocabulary, "idf": self.idf, "ngram_range": list(self.ngram_range),
            "stop_words": self.stop_words,
        }

    @classmethod
    def fit(
        cls, df: DataFrame, column: str, max_features: int = 500, ngram_range: tuple[int, int] = (1, 2),
        stop_words: list[str] | None = None,
    ) -> "TfIdf":
        if not 1 <= ngram_range[0] <= ngram_range[1] <= 3:
            raise ValueError("n-grams of 1 to 3 tokens")
        model = cls([], [], ngram_range, stop_words)
        # Terms of a row in order, each with whether it is the first of its kind there: one count by term then tells
        # both how often it stands in the corpus and in how many rows. Sorted and marked without a lambda, so that
        # neither is interpreted term by term.
        sorted_terms = spread(df.select(column)).select(F.sort_array(model._terms(column)).alias("s"))
        placed = sorted_terms.select("s", F.posexplode("s").alias("i", "term"))
        terms = placed.select("term", (~F.col("term").eqNullSafe(F.get("s", F.col("i") - 1))).alias("first"))
        counts = terms.groupBy("term").agg(F.count("*").alias("n"), F.count_if("first").alias("rows"))
        top = counts.orderBy(F.desc("n"), "term").limit(max_features).collect()  # at most max_features rows
        model.vocabulary = [r["term"] for r in top]
        if model.vocabulary:
            n = df.count()
            model.idf = [math.log((1 + n) / (1 + r["rows"])) + 1 for r in top]
        return model

    def _terms(self, column: str):
        return ngrams(tokens(ref(column), self.stop_words), *self.ngram_range)

    def _counts(self, df: DataFrame, column: str, name: str) -> DataFrame:
        with_terms = df.withColumn("_terms", self._terms(column))
        counter = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="_terms", outputCol=name)
        return counter.transform(with_terms).drop("_terms")

    def transform(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """Add the sparse vector `name` (or replace the text column when the names are equal)."""
        if not self.vocabulary:
            empty = CountVectorizerModel.from_vocabulary(["\u0000"], inputCol="_terms", outputCol="_w")
            out = empty.transform(df.withColumn("_terms", F.array().cast("array<string>"))).drop("_terms")
            return out.drop(name).withColumnRenamed("_w", name) if name in df.columns else out.withColumnRenamed("_w", name)
        counted = self._counts(df, column, "_tf")
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_raw"
        ).transform(counted)
        normal = Normalizer(p=2.0, inputCol="_raw", outputCol="_w").transform(weighted)
        return normal.drop("_tf", "_raw", name).withColumnRenamed("_w", name)

    def long_form(self, df: DataFrame, key: str, column: str) -> DataFrame:
        """(key, term, weight) of every term present."""
        vectors = self.transform(spread(df.select(key, column)), column, "_v")
        sparse = F.unwrap_udt(F.col("_v"))
        parts = vectors.select(key, F.inline(F.arrays_zip(sparse["indices"].alias("i"), sparse["values"].alias("w"))))
        words = F.array(*[F.lit(t) for t in self.vocabulary])
        return parts.select(key, F.get(words, F.col("i")).alias("term"), F.col("w").alias("weight"))
