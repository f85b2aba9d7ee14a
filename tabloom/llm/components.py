"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import pin


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) reaches.

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger neighbours, then
    every node and its smaller neighbours are tied to the smallest of them. The number of rounds grows with the
    logarithm of the longest path; edges never become more; each round is stored. A round that does not end in
    `rounds` steps raises.
    """
    links = pin(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    for _ in range(rounds):
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(links.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo < hi").distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(lowest, "hi")
        small = joined.select(F.col("m").alias("lo"), "hi").union(joined.select("m", "lo"))
        after = pin(small.where("lo < hi").distinct())
        changed = after.join(links, ["lo", "hi"], "left_anti").limit(1).count()
        same_size = after.count() == links.count()
        links = after
        if not changed and same_size:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component")).distinct()
