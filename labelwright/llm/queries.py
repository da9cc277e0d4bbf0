"""The registered query of each operator: the whole intended table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import bpe, conversations, fingerprints, language, lattice_dedup, line_dedup, mixing, quality, repeats, shingle_join, topk, url_filter, vector_codes
from labelwright.llm.common import remainder, table
from labelwright.session import cut_lineage

VOCABULARY = "byte_bpe_50k.tiktoken"


def token_digests(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    decoded = bpe.round_trip_documents(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, n_lines, n_removed = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured, features = quality.with_features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    featured = cut_lineage(featured.select("doc_id", features))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.fit_on_labels(featured, features, table(spark, sf_dir, "labels"), keep=~held_out)
    scored = featured.select("doc_id", held_out.alias("held_out"), quality.score_column(F.col(features), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    judged = language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", F.array_join(F.array_sort(F.map_keys("languages")), ",").alias("language_set"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link_documents(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = fingerprints.edited_documents(table(spark, sf_dir, "documents"))
    made = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprints.fingerprint(F.col("text")).alias("fingerprint"),
                         fingerprints.fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return made.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.audit_conversations(damaged, present=F.col("present"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.code_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = cut_lineage(coded.rows)
    out = vector_codes.with_group_total(rows, "label", coded.error, "label_error")
    return out.select("vec_id", F.lower(F.hex(coded.code)).alias("code"), F.col(coded.error).alias("error"), "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def op13_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_line_dedup, op3_quality, op4_repeated_passages, op5_language, op6_mix_sources, op7_shingle_join, op8_top_k,
                                   op9_fingerprints, op10_url_filter, op11_repair_conversations, op12_vector_codes, op13_lattice_dedup)}
