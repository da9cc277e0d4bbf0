"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.session import cut_lineage

#: A round reads as many edges in a task, or more; fewer edges in as many tasks would cost more than the work.
TASK_EDGES = 4096


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest node next to (or equal to) each node: the larger neighbours, or the others. Edges may repeat."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    hung = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        met.select("a", F.col("m").alias("b")))
    return hung.where("a <> b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``: the smallest node that links reach. Nodes without an edge are absent.

    Edges with a null end or equal ends say nothing; repeated ones count once; no edges give an empty table. A round
    aggregates and joins, gathers no group in one place, and is written to the shared folder; the number of rounds grows
    with the logarithm of the longest chain.
    """
    current = cut_lineage(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    mark = None
    for _ in range(max_rounds):
        current = cut_lineage(_star(_star(current, True), False).distinct())
        found = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (found["n"], found["h"]):
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (found["n"], found["h"])
        current = current.coalesce(1 + found["n"] // TASK_EDGES)
    raise RuntimeError("components did not settle")
