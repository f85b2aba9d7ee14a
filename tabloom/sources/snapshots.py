"""Table snapshots with content fingerprints and a manifest."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import ref

MANIFEST_SCHEMA = (
    "name string, path string, kind string, fingerprint string, short8 string, n_rows bigint, created_at bigint"
)


def _row_digest(df: DataFrame) -> Column:
    """md5 over all cells as text; null and '' differ, and a cell cannot run into its neighbour."""
    cells = [F.coalesce(F.concat(F.lit("="), ref(c).cast("string")), F.lit("~")) for c in df.columns]
    return F.md5(F.concat_ws("\u001f", *cells))


def digest_sum(digests: DataFrame, digest: str) -> DataFrame:
    """One row (n_rows, fingerprint) from md5 digests; sums make it independent of row order and partitioning."""
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    summed = digests.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").alias("total"))
    text = F.concat_ws("|", F.col("n_rows").cast("string"), F.col("total").cast("string"))
    return summed.select("n_rows", F.md5(text).alias("fingerprint"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Content hash of a table: one scan, map-side combined, no shuffle of rows."""
    return digest_sum(df.select(_row_digest(df).alias("d")), "d")


def write_snapshot(df: DataFrame, lake: str, prefix: str = "dataset", now: int | None = None) -> dict:
    """Write the table as `<prefix>_<epoch>` under `lake` and add a row to the manifest.

    The fingerprint is taken from the written files, so it describes exactly what was stored.
    """
    spark = df.sparkSession
    created = int(time.time()) if now is None else now
    name = f"{prefix}_{created}"
    path = f"{lake}/raw/{name}.parquet"
    df.write.mode("errorifexists").parquet(path)
    one = fingerprint(spark.read.parquet(path)).first()
    row = {
        "name": name, "path": path, "kind": "table", "fingerprint": one["fingerprint"],
        "short8": one["fingerprint"][:8], "n_rows": one["n_rows"], "created_at": created,
    }
    _append(spark, lake, row)
    return row


def register_image_set(index_fingerprint: DataFrame, lake: str, name: str, path: str, now: int | None = None) -> dict:
    """Add an image directory to the manifest."""
    one = index_fingerprint.first()
    row = {
        "name": name, "path": path, "kind": "images", "fingerprint": one["fingerprint"],
        "short8": one["fingerprint"][:8], "n_rows": one["n_rows"], "created_at": int(time.time()) if now is None else now,
    }
    _append(index_fingerprint.sparkSession, lake, row)
    return row


def _append(spark: SparkSession, lake: str, row: dict) -> None:
    columns = [F.lit(row[f.split(" ")[0]]).alias(f.split(" ")[0]) for f in MANIFEST_SCHEMA.split(", ")]
    spark.range(1).select(*columns).coalesce(1).write.mode("append").parquet(f"{lake}/manifest")


def list_snapshots(spark: SparkSession, lake: str, kind: str | None = None) -> DataFrame:
    """Manifest rows, newest first."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{lake}/manifest")
    if kind is not None:
        manifest = manifest.where(F.col("kind") == kind)
    return manifest.orderBy(F.desc("created_at"), "name")


def lookup_fingerprint(spark: SparkSession, lake: str, path: str) -> DataFrame:
    """Manifest fingerprint of a stored table by its path."""
    return list_snapshots(spark, lake).where(F.col("path") == path).select("fingerprint", "short8")
