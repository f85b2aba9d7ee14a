"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Runs of one to three lower-cased characters are hashed into `BUCKETS` counters. The model is fitted on at most
`FIT_ROWS` labelled rows a language (those with the smallest hash of their id); its matrix of log probabilities, of
buckets times languages, is broadcast, and whole texts are scored in batches of numpy. A text that is null or has no
letter is `und` with score 0; without any training row all texts are. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.arrays import chunks

BUCKETS = 1 << 15
FIT_ROWS = 2000
ORDERS = 3
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
_LETTER = regex.compile(r"\p{L}")


def gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that begins at each character; starts and ends of the texts there."""
    gap = "\0" * ORDERS
    lowered = [x.lower() for x in texts]
    flat = np.frombuffer((gap.join(lowered) + gap).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    length = np.array([len(x) for x in lowered], dtype=np.int64)
    start = np.cumsum(length + ORDERS) - length - ORDERS
    out, value = [], np.zeros(len(flat) - ORDERS, dtype=np.uint32)
    for k in range(ORDERS):
        value = (value ^ (flat[k : len(flat) - ORDERS + k] + np.uint32(k))) * _FACTORS[k]
        value ^= value >> np.uint32(15)
        out.append((value & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out, start, start + length


class LanguageModel:
    """Languages and the log probabilities of buckets; a language is a row."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, log_prob: np.ndarray):
        self.languages, self.log_prior, self.log_prob = languages, log_prior, log_prob.astype(np.float32)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for lo, hi in chunks(texts, 1_000_000):
            part = [x if x and _LETTER.search(x) else "" for x in texts[lo:hi]]
            if not self.languages:
                yield from ((UNKNOWN, 0.0) for _ in part)
                continue
            grams, start, end = gram_buckets(part)
            some = end > start
            score = np.tile(self.log_prior, (len(part), 1))
            edges = np.column_stack((start[some], end[some])).ravel()
            for row, weights in enumerate(self.log_prob):
                for bucket in grams:
                    if len(edges):
                        found = np.append(weights[bucket].astype(np.float64), 0.0)
                        score[some, row] += np.add.reduceat(found, edges)[::2]
            best = score.argmax(axis=1)
            share = 1.0 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
            for i, x in enumerate(part):
                yield (self.languages[best[i]], float(share[i])) if x else (UNKNOWN, 0.0)


def fit_languages(labelled: DataFrame, rows: int = FIT_ROWS) -> LanguageModel:
    """A model from columns doc_id, text and lang. Counts are summed by Spark, at most buckets times languages rows."""
    usable = labelled.where("text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    chosen = usable.select("lang", "doc_id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows)
    picked = F.broadcast(chosen.select("doc_id").distinct())  # at most `rows` ids a language
    sample = usable.join(picked, "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, 1_000_000):
                grams, start, end = gram_buckets(texts[lo:hi])
                for i, lang in enumerate(langs[lo:hi]):
                    total = sums.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                    total[BUCKETS] += 1
                    for bucket in grams:
                        total[:BUCKETS] += np.bincount(bucket[start[i] : end[i]], minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"]
            )

    partial = sample.mapInArrow(count, "lang string, bucket long, n long")
    counted = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, bucket, n = (counted.column(k) for k in range(3))
    names = sorted(set(langs.to_pylist()))
    table = np.zeros((len(names), BUCKETS + 1))
    row = np.array([names.index(x) for x in langs.to_pylist()], dtype=np.int64)
    table[row, bucket.to_numpy()] = n.to_numpy()
    docs, grams = table[:, BUCKETS], table[:, :BUCKETS] + 0.5
    prior = np.log((docs + 1) / (docs.sum() + len(names))) if names else np.zeros(0)
    return LanguageModel(names, prior, np.log(grams / grams.sum(axis=1, keepdims=True)))


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """doc_id, held (passed through), lang_pred and score of each row of (doc_id, held, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.predict(batch.column(2).to_pylist()))
            columns = [batch.column(0), batch.column(1)]
            columns += [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", "held_out", text).mapInArrow(run, schema)
