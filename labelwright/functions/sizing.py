"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast when the side holds at most ``max_rows``; otherwise leave the join to Spark (sort-merge).

    The check reads no more than ``max_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Give the rows of a table of few input splits to every core before CPU-heavy work.

    ``scan`` is the table scan that decides; one with enough splits leaves ``df`` as it is, so at scale
    nothing is shuffled.
    """
    scan = df if scan is None else scan
    if scan.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if scan.rdd.getNumPartitions() < cores else df
