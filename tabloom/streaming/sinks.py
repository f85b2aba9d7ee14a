"""Running a stream over everything available and reading its result back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import scratch_path


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream to the end of its input into Parquet; returns the written table."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    started = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/checkpoint")
        .option("path", f"{out}/data").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_update(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update stream to the end of its input; returns the last version of every key.

    Each micro-batch is one folder named by its id, written with overwrite, so a retried batch replaces
    its own rows and nothing is counted twice.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    started = (
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    started.awaitTermination()
    versions = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")
    values = [c for c in versions.columns if c not in keys and c != "batch"]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
