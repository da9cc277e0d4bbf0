"""Exact top-k by inner product: a KD-tree per shard, searched best box first."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
LEAF_ROWS = 512
#: Shards that one task searches one after the other, handing on the kth score.
SHARDS_PER_TASK = 2
OUT = "query_id long, vec_id long, score long"


def whole_components(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as longs; null if the vector is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


class Tree:
    """Median splits along the widest side of the tight bounding box, down to leaves of ``leaf_rows`` rows."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.ids, self.points = ids, points
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._grow(np.arange(len(ids)), leaf_rows)

    def _grow(self, rows: np.ndarray, leaf_rows: int) -> int:
        me = len(self.rows)
        part = self.points[rows]
        low, high = part.min(0), part.max(0)
        self.low.append(low)
        self.high.append(high)
        self.kids.append(None)
        self.rows.append(rows)
        if len(rows) > leaf_rows and (high > low).any():
            side = int((high - low).argmax())
            order = np.argpartition(part[:, side], len(rows) // 2)
            half = len(rows) // 2
            self.kids[me] = (self._grow(rows[order[:half]], leaf_rows), self._grow(rows[order[half:]], leaf_rows))
            self.rows[me] = None
        return me

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest inner product that a point of each box can have with each query."""
        return np.maximum(queries, 0) @ np.array(self.high).T + np.minimum(queries, 0) @ np.array(self.low).T


class Best:
    """The k best of each query so far: score first, smaller id on ties."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [[] for _ in range(n)]

    def kth(self, q: int):
        return self.scores[q][0][0] if len(self.scores[q]) == self.k else None

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        heap = self.scores[q]
        limit = self.kth(q)
        near = np.flatnonzero(scores >= limit) if limit is not None else np.arange(len(scores))
        if len(near) > self.k:
            near = near[np.lexsort((ids[near], -scores[near]))[:self.k]]
        for i in near.tolist():
            item = (int(scores[i]), -int(ids[i]))
            if len(heap) < self.k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Visit the boxes of each query from the highest bound down, until none can reach its kth score."""
    bounds = tree.bounds(queries)
    for q in range(len(queries)):
        frontier = [(-bounds[q, 0], 0)]
        while frontier:
            bound, node = heapq.heappop(frontier)
            kth = best.kth(q)
            if kth is not None and -bound < kth:
                break
            if tree.kids[node] is not None:
                for kid in tree.kids[node]:
                    heapq.heappush(frontier, (-bounds[q, kid], kid))
                continue
            rows = tree.rows[node]
            scores, ids = tree.points[rows] @ queries[q], tree.ids[rows]
            own = ids != query_ids[q]
            best.offer(q, ids[own], scores[own])


def _points(vectors: pd.Series) -> np.ndarray:
    """As doubles where every product sum is exact in them, else as Python integers."""
    points = np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), -1)
    return points


def _search_group(k: int):
    def run(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or shards.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        asked, given = _points(queries["_v"]), _points(shards["_v"])
        widest = float(np.abs(asked).max(initial=0)) * float(np.abs(given).max(initial=0)) * max(1, asked.shape[1])
        kind = np.float64 if widest < 2 ** 53 else object
        asked, given = asked.astype(kind), given.astype(kind)
        best, ids, at = Best(len(asked), k), shards["vec_id"].to_numpy(), shards["_shard"].to_numpy()
        for shard in np.unique(at):
            mine = at == shard
            search(Tree(ids[mine], given[mine]), queries["query_id"].to_numpy(), asked, best)
        rows = [(int(q), -i, s) for q, heap in zip(queries["query_id"], best.scores) for s, i in heap]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS,
          query_rows: int = QUERY_ROWS, shards_per_task: int = SHARDS_PER_TASK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query with the other vectors.

    Every query row is compared with every row of another id and its own number of components; ties go to the smaller
    id, and with fewer than k candidates all are given. Null vectors, null ids and vectors with null or non-finite
    components take no part; a repeated id counts as one vector, its first by components. Vectors are dealt to shards
    by a hash of their id and queries to blocks, so a task holds one block and a few shards. An inner product beyond a
    long is an error.
    """
    points = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), whole_components(F.col(vector), scale).alias("_v"), is_query.alias("_q")).where("_v is not null")
    points = points.groupBy("vec_id").agg(F.min("_v").alias("_v"), F.first("_q").alias("_q")).withColumn("_d", F.size("_v"))
    sizes = points.agg(F.count("*").alias("n"), F.count_if("_q").alias("q")).first()
    shards, blocks = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["q"] // query_rows))
    tasks = max(1, -(-shards // shards_per_task))
    asked = (points.where("_q").select(F.col("vec_id").alias("query_id"), "_v", "_d", F.pmod(F.xxhash64(F.lit(1), F.col("vec_id")), F.lit(blocks)).alias("_block"))
             .withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))))
    given = (points.select("vec_id", "_v", "_d", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("_shard")).withColumn("_task", (F.col("_shard") % tasks).cast("int"))
             .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    found = asked.groupBy("_d", "_block", "_task").cogroup(given.groupBy("_d", "_block", "_task")).applyInPandas(_search_group(k), OUT)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
