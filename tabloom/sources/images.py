"""Image directories: label index and content fingerprint."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.fixed import IMAGE_FILES
from tabloom.sources.snapshots import digest_sum


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_FILES).load(folder)
    )


def image_index(spark: SparkSession, folder: str) -> DataFrame:
    """(image, label) of every image below the folder; the label is the parent directory. File bytes are not read; empty files are not listed."""
    parts = F.split("path", "/")
    return _files(spark, folder).select(F.col("path").alias("image"), F.element_at(parts, -2).alias("label"), "length")


def images_per_label(index: DataFrame) -> DataFrame:
    return index.groupBy("label").agg(F.count("*").alias("n_images"))


def image_set_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Content hash of all images with their place below the folder, whatever the listing order."""
    root = re.sub(r"^[A-Za-z0-9]+:(//[^/]*)?", "", folder).rstrip("/") + "/"
    below = F.substring(F.col("path"), F.instr("path", root) + len(root), F.length("path"))
    digest = F.md5(F.concat_ws("|", below, F.md5("content")))
    return digest_sum(_files(spark, folder).select(digest.alias("d")), "d")
