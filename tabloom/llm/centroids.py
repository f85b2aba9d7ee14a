"""Operator 13: clustering around integer centroids with JVM-native expressions only.

Each component becomes an integer, so sums and distances are exact and no order of addition changes a result. The
centroids of a round are literal arrays in the plan (at most `clusters` of them). `zip_with` and `aggregate` compute
the squared distance to each, `array_min` over structs of distance and number picks the nearest, the smaller number on
ties. One aggregate with a sum a component gives the next centroids: partial sums are formed where the rows lie, so a
cluster with most of the rows costs no more than others, and `clusters` rows come back to the driver. The vectors are
read from their table in each round and never shuffled; only the last assignment is written, without vectors.

Vectors that are null, of another size, or that hold null or non-finite components take no part, neither do those with
a component of 2**21 or more, whose distances do not fit into a long. Rows without an id are clustered, but start a
centroid only after all others. Repeated rows count as often as they occur. With fewer vectors than clusters each
vector starts one. A table without usable vectors gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import pin

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Integers of a smaller magnitude have squared distances within a long.
LIMIT = 1 << 27


def integer_vectors(df: DataFrame, vector: str, key: str, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """Key and integer components (`v`) of the usable vectors."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / scale))
    usable = df.where((F.size(x) == size) & fits)
    return usable.select(F.col(f"`{key}`").alias("key"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = "1") -> list[list[int]]:
    """Vectors with the smallest hashes of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    chosen = vectors.orderBy(digest.asc_nulls_last(), "v").limit(clusters)
    return [r["v"] for r in chosen.select("v").collect()]


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """Struct of the squared distance to the nearest centroid and its number."""
    literal = F.array(*[F.lit(np.array(c, dtype=np.int64)) for c in centroids])

    def apart(centroid: Column, number: Column) -> Column:
        squares = F.zip_with(vector, centroid, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0).cast("long"), lambda s, d: s + d).alias("distance"), number.alias("cluster"))

    return F.array_min(F.transform(literal, apart))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids at the floors of the means of their vectors; those without vectors stay."""
    size = len(centroids[0])
    assigned = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(size)]
    rows = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()  # one a cluster
    out = list(centroids)
    for r in rows:
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    return out


def fit_centroids(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> list[list[int]]:
    centroids = first_centroids(vectors, clusters)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids)
    return centroids


def cluster_vectors(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", size: int = SIZE, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """Key, cluster, distance, cluster_inertia, inertia and centroid (array of integers) of every usable vector."""
    vectors = integer_vectors(df, vector, key, size, scale)
    centroids = fit_centroids(vectors, clusters, rounds)
    found = nearest(F.col("v"), centroids or [[0] * size])
    assigned = pin(vectors.select("key", found.alias("found")).select("key", "found.*"))
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = {r["cluster"]: r["cluster_inertia"] for r in inertia.collect()}  # one a cluster
    rows = [(k, total[k], sum(total.values()), c) for k, c in enumerate(centroids) if k in total]
    names = "cluster int, cluster_inertia long, inertia long, centroid array<long>"
    figures = F.broadcast(df.sparkSession.createDataFrame(rows, names))  # one row a cluster
    return assigned.join(figures, "cluster").withColumnRenamed("key", key)


def centroid_print(centroid: Column) -> Column:
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
