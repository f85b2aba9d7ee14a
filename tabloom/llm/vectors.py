"""Operator 9: approximate nearest neighbours with robust-pruned graphs, one a shard.

Equal vectors form a class that keeps its smallest ids, so a vector that occurs any number of times is one node of a
graph. Classes are dealt into shards of about `SHARD_ROWS` by hash. In each shard a directed graph is built in two
passes: greedy searches from a central node propose neighbours for a batch of nodes, and pruning keeps a neighbour only
if no kept one is nearer to it by the relaxation factor, which leaves edges in diverse directions. Built graphs are
stored as one bounded row a shard. Blocks of queries meet every shard in a beam search; distances of what it finds are
computed again in double precision and the best of all shards are kept.

Vectors that are null, empty, zero or hold null or non-finite components take no part, and only vectors of equal length
are compared. A row that is repeated with the same id counts once. With too few candidates all of them are returned; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import pin

SHARD_ROWS = 2048
DEGREE, BEAM, RELAX = 24, 64, 1.2
BLOCK = 256


def usable(vector: str) -> Column:
    """Whether a vector has finite components only and is not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


class Graph:
    """A directed graph over the rows of `points`; -1 fills up unused places of `edges`."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, start: int | None = None):
        self.points = points
        self.start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()) if start is None else start
        self.edges = edges

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest nodes found (-1 where there are no more), their squared distances, and the nodes expanded."""
        n, rows = len(self.points), np.arange(len(queries))
        ids = np.full((len(queries), beam), -1, dtype=np.int64)
        dist = np.full((len(queries), beam), np.inf, dtype=np.float32)
        ids[:, 0] = self.start
        dist[:, 0] = ((queries - self.points[self.start]) ** 2).sum(axis=1)
        closed = np.zeros((len(queries), beam), dtype=bool)
        seen = np.zeros((len(queries), n + 1), dtype=bool)
        seen[:, self.start] = True
        seen[:, n] = True
        path = []
        while True:
            open_ = ~closed & (ids >= 0)
            live = rows[open_.any(axis=1)]
            if not live.size:
                break
            at = open_[live].argmax(axis=1)
            now = ids[live, at]
            closed[live, at] = True
            step = np.full(len(queries), -1, dtype=np.int64)
            step[live] = now
            path.append(step)
            near = self.edges[now]
            near = np.where(near < 0, n, near)
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            gap = self.points[np.minimum(near, n - 1)] - queries[live, None, :]
            d = np.where(fresh, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
            all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
            all_dist = np.concatenate((dist[live], d), axis=1)
            all_closed = np.concatenate((closed[live], np.zeros(near.shape, dtype=bool)), axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(all_ids, order, axis=1)
            dist[live] = np.take_along_axis(all_dist, order, axis=1)
            closed[live] = np.take_along_axis(all_closed, order, axis=1)
        return ids, dist, np.array(path).T if path else np.zeros((len(queries), 0), dtype=np.int64)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """Up to DEGREE of each node's candidates (-1: none), nearest first; one goes if a kept one is closer to it."""
        candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
        again = np.zeros(candidates.shape, dtype=bool)
        again[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
        there = (candidates >= 0) & ~again
        points = self.points[np.maximum(candidates, 0)]
        gap = points - self.points[nodes][:, None, :]
        dist = np.where(there, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
        out = np.full((len(nodes), DEGREE), -1, dtype=np.int64)
        rows = np.arange(len(nodes))
        left = dist.copy()
        for k in range(DEGREE):
            best = left.argmin(axis=1)
            some = np.isfinite(left[rows, best])
            if not some.any():
                break
            out[some, k] = candidates[some, best[some]]
            between = points - points[rows, best][:, None, :]
            between = np.einsum("ijk,ijk->ij", between, between)
            left[some] = np.where((relax**2 * between <= dist)[some], np.inf, left[some])
            left[rows, best] = np.inf
        return out

    def build(self, seed: int = 5, beam: int = 48) -> Graph:
        draw, n = np.random.default_rng(seed), len(self.points)
        self.edges = np.full((n, DEGREE), -1, dtype=np.int64)
        if n > 1:
            random = draw.integers(0, n - 1, size=(n, min(DEGREE // 2, n - 1)))
            self.edges[:, : random.shape[1]] = random + (random >= np.arange(n)[:, None])
        for relax in (1.0, RELAX):
            order = draw.permutation(n)
            for lo in range(0, n, BLOCK):
                nodes = order[lo : lo + BLOCK]
                found, _, path = self.search(self.points[nodes], beam)
                mine = self.prune(nodes, np.concatenate((found, path[:, :beam], self.edges[nodes]), axis=1), relax)
                self.edges[nodes] = mine
                self._back(nodes, mine, relax)
        return self

    def _back(self, nodes: np.ndarray, mine: np.ndarray, relax: float) -> None:
        """Add the reverse of new edges; nodes with too many are pruned."""
        source = np.repeat(nodes, DEGREE)[mine.ravel() >= 0]
        target = mine.ravel()[mine.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        if not heads.size:
            return
        wide = np.full((len(heads), DEGREE + int(count.max())), -1, dtype=np.int64)
        wide[:, :DEGREE] = self.edges[heads]
        wide[np.repeat(np.arange(len(heads)), count), DEGREE + np.arange(len(target)) - np.repeat(first, count)] = source
        self.edges[heads] = self.prune(heads, wide, relax)


def build_index(rows: DataFrame, keep: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row a shard: size (length of vectors), shard, points, edges, members (the `keep` smallest ids of each
    class) and start; stored."""
    valid = rows.where(usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    valid = valid.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    keyed = valid.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    nth = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))
    few = keyed.withColumn("nth", nth).where(F.col("nth") <= keep)
    classes = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    classes = pin(classes.withColumn("size", F.size("v")))
    shards = max(1, -(-classes.count() // SHARD_ROWS))
    dealt = classes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h1", "h2"])
        points = np.stack(group["v"].to_numpy()).astype(np.float64)
        graph = Graph(points.astype(np.float32)).build()
        members = np.full((len(points), keep), -1, dtype=np.int64)
        there = np.zeros((len(points), keep), dtype=bool)
        for i, ids in enumerate(group["ids"]):
            members[i, : len(ids)] = ids
            there[i, : len(ids)] = True
        row = [int(group["size"].iloc[0]), int(group["shard"].iloc[0]), graph.start]
        blobs = [points.tobytes(), graph.edges.astype("<i4").tobytes(), members.tobytes(), there.tobytes()]
        return pd.DataFrame([row + blobs], columns=["size", "shard", "start", "points", "edges", "members", "there"])

    schema = "size int, shard int, start int, points binary, edges binary, members binary, there binary"
    return pin(dealt.groupBy("size", "shard").applyInPandas(build, schema))


def search_index(index: DataFrame, queries: DataFrame, keep: int, nearest: int) -> DataFrame:
    """query_id, vec_id and score of the best of each shard for queries (id, v); `keep` as in the index."""
    blocks = queries.withColumns({"size": F.size("v"), "block": F.pmod(F.xxhash64("id"), F.lit(1 << 30))})
    count = max(1, -(-queries.count() // BLOCK))
    blocks = blocks.withColumn("block", F.pmod("block", F.lit(count)))
    blocks = blocks.groupBy("size", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                size = int(row.size)
                points = np.frombuffer(row.points, dtype=np.float64).reshape(-1, size)
                members = np.frombuffer(row.members, dtype=np.int64).reshape(len(points), keep)
                there = np.frombuffer(row.there, dtype=bool).reshape(len(points), keep)
                edges = np.frombuffer(row.edges, dtype="<i4").reshape(len(points), -1).astype(np.int64)
                ids = np.array([q["id"] for q in row.queries], dtype=np.int64)
                v = np.array([q["v"] for q in row.queries], dtype=np.float64)
                graph = Graph(points.astype(np.float32), edges, int(row.start))
                found, _, _ = graph.search(v.astype(np.float32), BEAM)
                exact = np.sqrt(((points[np.maximum(found, 0)] - v[:, None, :]) ** 2).sum(axis=2))
                other = np.where(there[np.maximum(found, 0)] & (found >= 0)[:, :, None], 1, 0).astype(bool)
                named = members[np.maximum(found, 0)]
                other &= named != ids[:, None, None]
                out = []
                for i, q in enumerate(ids):
                    name, score = named[i][other[i]], np.repeat(exact[i], other[i].sum(axis=1))
                    best = np.lexsort((name, score))[:nearest]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": name[best], "score": score[best]}))
                yield pd.concat(out)

    met = index.join(blocks, "size")
    return met.mapInPandas(run, "query_id long, vec_id long, score double")


def nearest_neighbours(
    rows: DataFrame, queries: Column, nearest: int = 10, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """query_id, rank, vec_id and score of the `nearest` rows of each row for which `queries` holds."""
    index = build_index(rows, nearest + 1, vector, key)
    asked = rows.where(queries & usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )
    found = search_index(index, pin(asked.dropDuplicates(["id"])), nearest + 1, nearest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
