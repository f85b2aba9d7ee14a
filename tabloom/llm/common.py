"""Helpers of the operators: tables, row keys, dense ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import pin, scratch_path

#: Keys of rows without an id lie above all real ids.
NO_ID = 1 << 61


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The id, or where it is null a number made of the text, above all ids below 2**61."""
    made = F.lit(NO_ID) + F.pmod(F.xxhash64(F.lit("no id"), F.col(text)), F.lit(NO_ID))
    return F.coalesce(F.col(doc_id).cast("long"), made)


def dense_ranks(df: DataFrame, group: str, order: list[str], name: str, blocks: int = 256) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no group as one task.

    Rows of a group are dealt over `blocks` blocks by a hash of `order`; blocks are numbered one after the other and
    rows inside a block by `order`. `df` must be stored (it is read twice); counts of blocks are all that is added.
    The result depends on the rows only; equal rows get different numbers.
    """
    key = "__block"
    dealt = df.withColumn(key, F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = dealt.groupBy(group, key).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    sizes = sizes.withColumnsRenamed({group: "__group", key: "__sizes_block"})
    inside = Window.partitionBy(group, key).orderBy(*order)
    ranked = dealt.withColumn("__inside", F.row_number().over(inside) - 1)
    joined = ranked.join(sizes, F.col(group).eqNullSafe(F.col("__group")) & (F.col(key) == F.col("__sizes_block")))
    return joined.withColumn(name, F.col("__before") + F.col("__inside")).drop(
        "__group", "__sizes_block", key, "__before", "__inside"
    )


_WORKER: dict[tuple[str, str], object] = {}


def once_a_worker(kind: str, broadcast, stamp: str, make: Callable):
    """`make(broadcast.value)`, built once in each Python worker and kept until another `stamp` of the kind comes."""
    if (kind, stamp) not in _WORKER:
        for old in [k for k in _WORKER if k[0] == kind]:
            del _WORKER[old]
        _WORKER[kind, stamp] = make(broadcast.value)
    return _WORKER[kind, stamp]


def share_file(spark: SparkSession, path: str):
    """Broadcast a vocabulary file (its size does not depend on the data) with a stamp of its content."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return spark.sparkContext.broadcast(content), hashlib.sha256(content.encode()).hexdigest()


__all__ = ["NO_ID", "dense_ranks", "once_a_worker", "pin", "row_key", "scratch_path", "share_file", "table"]
