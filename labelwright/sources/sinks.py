"""Writers: reports, metrics, and the access-path layout of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which columns each stored table is looked up by.
LAYOUTS = {
    "scans": ("user_id", "date"),
    "revisions": ("review_status", "submitted_at"),
    "product_revisions": ("product_id", "version"),
    "audit_events": ("entity_id", "created_at"),
}


def report_rows(images: DataFrame) -> DataFrame:
    """Report rows addressed by scan, report and image, each kept apart."""
    report = F.concat(F.lit("RPT-"), F.upper(F.substring(F.sha2(F.concat_ws("|", F.col("scan_id").cast("string"), F.col("image_id").cast("string")), 256), 1, 12)))
    return images.withColumn("report_id", report).withColumn("day", F.to_date("created_at"))


def write_reports(images: DataFrame, path: str) -> None:
    """Append report rows, one folder per day."""
    report_rows(images).write.partitionBy("day").mode("append").parquet(path)


def replace_report_days(images: DataFrame, path: str) -> None:
    """Write report rows so that the days among them are replaced and all other days stay: a repeated run gives no copies."""
    report_rows(images).write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_metrics_jsonl(records: DataFrame, summary: DataFrame, path: str) -> None:
    """One JSON record per unit, and the summary next to them."""
    records.write.mode("overwrite").json(f"{path}/records")
    summary.write.mode("overwrite").json(f"{path}/summary")


def lay_out(df: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Rows arranged for their lookups: ranged by key and time, newest first within a key.

    Ranging on (key, time) cuts a key with very many rows into several files; Parquet statistics then prune both
    on the key and on the time.
    """
    key, recency = LAYOUTS[table]
    return df.repartitionByRange(buckets, F.col(key), F.col(recency).desc()).sortWithinPartitions(F.col(key), F.col(recency).desc())


def write_laid_out(df: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    lay_out(df, table, buckets).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, name: str, path: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by the key it is looked up by: joins and aggregates on the key shuffle nothing.

    One key lies in one bucket, so this is for keys of bounded size; ``write_laid_out`` cuts keys of any size.
    """
    key, recency = LAYOUTS[table]
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key, recency).saveAsTable(name)
