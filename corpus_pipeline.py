"""The corpus pipeline: quality classifier, line dedup, near duplicates, mixing, tokens. Each stage is one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import bpe, line_dedup, mixing, quality, shingle_join
from labelwright.llm.common import WORD, fresh, table
from labelwright.llm.queries import VOCABULARY

#: A document scored below this goes.
LEAST_QUALITY = 0.5
#: Near duplicates share this percentage of their five-word shingles, or more.
WIDTH, PERCENT = 5, 80
#: Bytes of a batch sent to a Python worker. The JVM and the worker both hold it, and Spark's own 64 MB take all texts of a task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def send_small_batches(spark: SparkSession) -> None:
    """For the session; a size that was set by the user stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least ``LEAST_QUALITY`` by a model fitted on all labelled ones. A text that is null or empty is
    scored like any other."""
    send_small_batches(spark)
    featured, features = quality.with_features(docs)
    model = quality.fit_on_labels(featured, features, table(spark, sf_dir, "labels"))
    return featured.where(quality.score_column(F.col(features), model) >= LEAST_QUALITY).drop(features)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without later copies of repeated line runs; n_chars follows the text. A document that consists of
    such copies alone goes: nothing of it is new."""
    cut, n_lines, n_removed = line_dedup.dedup_lines(docs)
    out = cut.where((F.col(n_removed) == 0) | F.col("text").rlike(WORD)).drop(n_lines, n_removed)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near duplicates; what line dedup left of a copy counts, not its first text."""
    send_small_batches(spark)
    return shingle_join.keep_one_of_each(docs, width=WIDTH, percent=PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per whole epoch of a document, and a last row cut to the words still needed."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with token ids, their number, and whether decoding gives the text back."""
    send_small_batches(spark)
    path = public_tokenizers.path(VOCABULARY)
    ids, decoded, n, same = (fresh(docs, x) for x in ("ids", "decoded", "n_tokens", "round_trip"))
    both = bpe.round_trip_documents(docs, path, public_tokenizers.PATTERN, ids=ids, decoded=decoded)
    return both.withColumn(n, F.size(ids).cast("long")).withColumn(same, F.col(decoded) == F.coalesce(F.col("text"), F.lit(""))).drop(decoded)


STAGES = [("quality classifier", keep_quality), ("line dedup", cut_repeated_lines), ("n-gram Jaccard join", keep_one_of_each_group),
          ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", tokenise)]

#: The classifier and the token machine are not SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
