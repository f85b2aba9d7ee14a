"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import stages
from tabloom.llm.common import scratch_path, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_common_lines),
    ("near_dedup", stages.keep_one_of_each_group),
    ("pii", stages.mask_personal_data),
    ("packing", stages.pack_sequences),
]

#: The trained classifier and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
