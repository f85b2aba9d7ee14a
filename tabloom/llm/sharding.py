"""Operator 4: shards by jump consistent hashing.

The jump hash needs the key and the number of shards, no ring table. Growing from n to n + 1 shards moves 1/(n + 1) of
the keys, all of them into the new shard. The key decides alone; a null key counts as one key of its own, equal keys
go to one shard, and an empty table gives an empty one. Texts may be null (size 1, checksum 0) or of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import dense_ranks, pin

SHARDS = 16
#: Multiplier of the jump hash's random numbers.
STEP = np.uint64(2862933555777941757)
NULL_KEY = -1


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last jump before `shards`, expected in ln(shards) steps."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    last, ahead = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while live.size:
        last[live] = ahead[live]
        state[live] = state[live] * STEP + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[live] = ((last[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return last


def hashed(key: Column) -> Column:
    """Nearby keys are spread by a hash first."""
    return F.xxhash64(F.coalesce(key.cast("long"), F.lit(NULL_KEY)))


def with_shards(rows: DataFrame, key: str, shards: dict[str, int]) -> DataFrame:
    """The rows with a shard column for each number of shards, in place of the hashed key.

    Only the columns given reach Python; next to a UDF column Spark would hold back whole input rows, texts included.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            added = [pa.array(jump(keys, n).astype(np.int32)) for n in shards.values()]
            rest = batch.drop_columns([key])
            yield pa.RecordBatch.from_arrays([*rest.columns, *added], [*rest.schema.names, *shards])

    fields = [f for f in rows.schema if f.name != key] + [T.StructField(n, T.IntegerType()) for n in shards]
    return rows.mapInArrow(place, T.StructType(fields))


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, size (UTF-8 bytes and 1), text_crc32, law, shard, slot and grown_shard of each row.

    Texts are read once and not shuffled; the narrow rows are stored and numbered block by block in their shard.
    """
    measured = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        hashed(F.col(key)).alias("__hashed"),
    )
    placed = pin(with_shards(measured, "__hashed", {"shard": shards, "grown_shard": shards + 1}))
    return dense_ranks(placed, "shard", ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
