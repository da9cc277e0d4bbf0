"""Versions, latest decisions, deduplication, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions.ordering import bucketed_row_number
from labelwright.functions.text import fold
from labelwright.session import cut_lineage


def version_number(revisions: DataFrame, product: str, created: str, tie: str) -> DataFrame:
    """Version = number of earlier revisions of the product + 1. Counted per month first, so that a product with
    very many revisions is not one task."""
    return bucketed_row_number(revisions, [product], [F.col(created), F.col(tie)], F.date_trunc("month", F.col(created)), "version")


def latest_decision(decisions: DataFrame, key: str, decided: str, tie: str) -> DataFrame:
    """Newest decision and length of the history; the decisions table itself is the append-only history."""
    newest = F.max_by(F.struct("action", decided, tie), F.struct(decided, tie))
    return (decisions.groupBy(key).agg(newest.alias("_d"), F.count("*").alias("history_length"))
            .select(key, F.col("_d.action").alias("action"), F.col(f"_d.{decided}").alias("decided_at"), "history_length"))


def decision_history(decisions: DataFrame, key: str, decided: str, tie: str) -> DataFrame:
    """Decisions numbered in order; month buckets keep a long history spread over tasks."""
    return bucketed_row_number(decisions, [key], [F.col(decided), F.col(tie)], F.date_trunc("month", F.col(decided)), "position")


def dedupe_lines(detections: DataFrame, order: list[str], doc: str = "doc_id") -> DataFrame:
    """First occurrence of each folded text per document; an aggregate, so repeats merge before the shuffle."""
    carried = [c for c in detections.columns if c != doc]
    first = F.min_by(F.struct(*carried), F.struct(*order))
    return (detections.withColumn("_key", fold(F.col("text"))).where(F.length("_key") > 0)
            .groupBy(doc, "_key").agg(first.alias("_f")).select(doc, "_f.*"))


def combine_images(detections: DataFrame, images: DataFrame, order: list[str]) -> DataFrame:
    """Per document: images read and failed, and the lines that remain after deduplication over good images."""
    state = images.groupBy("doc_id").agg(F.count("*").alias("images"), F.count_if(~F.col("success")).alias("failed_images"))
    good = detections.join(images.where("success").select("doc_id", "image_id"), ["doc_id", "image_id"], "left_semi")
    kept = dedupe_lines(good, order).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.avg("confidence").alias("confidence"))
    return state.join(kept, "doc_id", "left")


def rank_barcodes(barcodes: DataFrame, image: str = "image_id") -> DataFrame:
    """Valid first, then larger area, then top, left, symbology, value; ids are the rank. Ranked inside bands of
    area, so that an image with very many codes is not one task."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    staged = barcodes.withColumn("_area", area)
    order = [F.col("valid").desc(), F.col("_area").desc(), F.col("y1"), F.col("x1"), F.col("symbology"), F.col("raw_value")]
    band = F.struct((~F.col("valid")).alias("invalid"), (-F.floor(F.col("_area") / 1024)).alias("band"))
    ranked = bucketed_row_number(staged, [image], order, band, "_rn")
    return ranked.withColumn("barcode_pos", F.col("_rn") - 1).drop("_rn", "_area")


def rank_candidates(candidates: DataFrame, floor: float, n: int, image: str = "doc_id") -> DataFrame:
    """First n candidates per image by class, position and confidence; Spark keeps n per task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(image).orderBy("class_id", "y1", "x1", "y2", "x2", F.col("confidence").desc()))
    usable = (F.col("confidence") >= floor) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    return candidates.where(usable).withColumn("rank", rank).where(F.col("rank") <= n)


def recent_first(df: DataFrame, ts: str, tie: str, k: int) -> DataFrame:
    """The k newest rows: each task keeps k, the merge sees k per task."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(k)


SORTS = ("az", "za", "high", "low", "newest", "oldest")


def _list_order(how: str) -> Column:
    """A missing score sorts as -1 and a missing date as the epoch."""
    score = F.coalesce(F.col("score"), F.lit(-1.0))
    date = F.coalesce(F.col("date"), F.lit("1970-01-01").cast("timestamp"))
    return {"az": F.col("name").asc(), "za": F.col("name").desc(), "high": score.desc(), "low": score.asc(),
            "newest": date.desc(), "oldest": date.asc()}[how]


def sort_products(df: DataFrame, how: str, tie: str = "product_id") -> DataFrame:
    """Products in list order."""
    return df.orderBy(_list_order(how), F.col(tie))


def product_positions(df: DataFrame, how: str, tie: str = "product_id") -> DataFrame:
    """Place of every product in the list, from 1. Rows are ranged over all tasks in list order, ties included, and the
    ranges are the buckets of the numbering; they are stored, so a lost task finds the same ranges again."""
    order = [_list_order(how), F.col(tie)]
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return bucketed_row_number(ranged, [], order, F.col("_range"), "position").drop("_range")


def top_k_per_query(scored: DataFrame, query: str, score: Column, tie: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(query).orderBy(score.desc(), *tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def chain_links(events: DataFrame, chain: str, ts: str, tie: str) -> DataFrame:
    """Previous event of each chain. Days are linked inside a day; the first event of a day takes the last one of
    the nearest earlier day, found on one row per (chain, day)."""
    day = F.to_date(F.col(ts))
    order = [F.col(ts), F.col(tie)]
    staged = events.withColumn("_day", day)
    ends = staged.groupBy(chain, "_day").agg(F.max_by(F.col(tie), F.struct(ts, tie)).alias("_last"))
    before = ends.select(chain, "_day", F.lag("_last").over(W.partitionBy(chain).orderBy("_day")).alias("_before"))
    inside = F.lag(tie).over(W.partitionBy(chain, "_day").orderBy(*order))
    return (staged.withColumn("_prev", inside).join(before, [chain, "_day"])
            .withColumn("previous", F.coalesce("_prev", "_before")).drop("_day", "_prev", "_before"))


def union_engines(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    return left.withColumn("engine", F.lit(left_name)).unionByName(right.withColumn("engine", F.lit(right_name)))


def distinct_in_order(df: DataFrame, array_col: str) -> DataFrame:
    return df.withColumn(array_col, F.array_distinct(array_col))


def missing_from(df: DataFrame, required: Column, present: Column, out: str = "missing") -> DataFrame:
    return df.withColumn(out, F.array_except(required, present))


def intersects(df: DataFrame, a: Column, b: Column, out: str = "hit") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.arrays_overlap(a, b), F.lit(False)))
