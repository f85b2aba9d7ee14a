"""The stages of the corpus pipeline: documents in, documents out, and packed pieces at the end.

A stage takes (spark, docs, folder of the tables). All but the last keep the columns of `docs`, whatever else they are
called (names that begin with two underscores are reserved); where a text changes, n_chars follows it. Null texts stay
null, clean documents stay as they are. Repeated rows count as copies of each other only for near duplicates. An empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import row_key, table
from tabloom.llm.lines import drop_repeated_lines, text_print
from tabloom.llm.near import near_duplicates
from tabloom.llm.packing import pack
from tabloom.llm.personal import find_personal_data, mask
from tabloom.llm.queries import WORD_VOCABULARY, remainder, vocabulary_path
from tabloom.llm.toxicity import fit_toxicity, score_texts


def _with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    changed = docs.withColumn("text", text)
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return changed.select(*(F.col(f"`{c}`") for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the classifier scores 0.5 or more; fitted as the query of the operator is."""
    labels = table(spark, folder, "labels").where(remainder(5) > 0)
    model = fit_toxicity(table(spark, folder, "documents"), labels)
    return score_texts(docs, model).where("__toxic < 0.5").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that ten documents or more hold stay in their first occurrence only, so copied texts keep one copy."""
    kept = drop_repeated_lines(docs, keep_first=True)
    return _with_text(kept, F.col("__kept.text"), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Texts without words are duplicates of nothing and all stay. Of rows that agree in id and text one stays; rows that
    share an id but differ in their text go or stay together.
    """
    kept = near_duplicates(docs, words=5).where("doc = component_id").select(F.col("doc").alias("__doc")).distinct()
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    apart = F.when(blank, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    keyed = docs.withColumns({"__doc": row_key(), "__print": text_print(), "__apart": apart})
    single = keyed.join(kept, "__doc", "left_semi").dropDuplicates(["__doc", "__print", "__apart"])
    return single.select(*(F.col(f"`{c}`") for c in docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by the names of their kinds."""
    found = find_personal_data(docs).where(F.size("spans") > 0)
    spans = found.select(F.col("doc").alias("__doc"), F.col("print").alias("__print"), F.col("spans").alias("__spans"))
    keyed = docs.withColumns({"__doc": row_key(), "__print": text_print()})
    joined = keyed.join(spans.dropDuplicates(["__doc", "__print"]).hint("shuffle_hash"), ["__doc", "__print"], "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(mask(F.col("text"), F.col("__spans")))
    return _with_text(joined, text, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    return pack(docs, vocabulary_path(WORD_VOCABULARY))
