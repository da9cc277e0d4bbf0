"""Mixing sources to target weights: water-filled targets, whole epochs, then an Efraimidis-Spirakis selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.llm.common import WORD, fresh

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Runs of marks that clean prose does not have.
NOISE = r"[#$%&*|!]{2,}"
BUCKETS = 1024


def size_of(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Between 0.2 and 1: falls with the share of words that carry runs of marks. 1 for a text without words."""
    noise = F.coalesce(F.regexp_count(text, F.lit(NOISE)), F.lit(0)).cast("double")
    return F.when(size > 0, size / (size + F.lit(4.0) * F.least(noise, size.cast("double")))).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size)`` with one row per source to the same with ``target``.

    Sources by code point, null last, take the weights in turn. The targets add up to ``share`` of all sizes, a
    source's target stops at ``most`` times its size, and what is above goes to the others by weight. Sources stop in
    the order of size per weight, so one running sum over the table of sources finds the level that all others share.
    """
    place = W.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("_w", turn).withColumn("_cap", F.lit(most) * F.col("source_size"))
    ratio = F.col("_cap") / F.col("_w")
    upto = W.partitionBy(F.lit(0)).orderBy(ratio, F.col("source").cast("binary").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    summed = weighed.withColumn("_full", F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))).withColumn(
        "_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0))).withColumn("_all", F.lit(share) * F.sum("source_size").over(every))
    level = (F.col("_all") - F.col("_full")) / F.col("_left")
    # levels rise until the first source that does not stop and fall behind it; when all stop, none is needed
    shared = summed.withColumn("_level", F.max(F.when(ratio >= level, level)).over(every))
    return shared.select("source", "source_size", F.when(F.col("_level").isNull() | (ratio <= F.col("_level")), F.col("_cap"))
                         .otherwise(F.col("_level") * F.col("_w")).alias("target"))


def random_unit(doc_id: Column) -> Column:
    """In (0, 1), from the md5 of the id as text: the same in every run and on every machine."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 12), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE,
                most: float = MOST, buckets: int = BUCKETS, quality=quality_of) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (its source's) and taken, the words the mix takes.

    A source is taken whole as often as its target allows. What is left is filled in the order of exponential keys
    -ln(u) / quality; the document at the end gives only the words that are still missing, so a source takes its target
    to the nearest word, and no document more than ``most`` times its size. Ties go by doc_id, nulls first, then size.
    Null and empty texts have size 0 and take nothing; a null source is a source; repeated rows are separate
    documents; an empty table gives an empty result; other columns play no part.

    Keys are dealt to ``buckets`` ranges per source, sums per range are kept, and only the range in which the
    selection ends is sorted, so a source of any size is never in one task.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_text"))
    base = base.withColumn("size", size_of(F.col("_text")))
    base = base.select("doc_id", "source", "size", (-F.ln(random_unit(F.col("doc_id"))) / quality(F.col("_text"), F.col("size"))).alias("_key"))
    base = base.withColumn("_bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * buckets), F.lit(buckets - 1)))
    sums = base.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    plan = (sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
            .join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("_epochs", epochs).withColumn("_rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size")))
    placed = base.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    # 1: the whole range is taken, 0: none of it, null: the selection ends in it
    whole = F.when(F.col("_before") + F.col("_sum") <= F.col("_rest"), 1).when(F.col("_before") >= F.col("_rest"), 0)
    placed = placed.withColumn("_whole", whole)
    settled = placed.where("_whole is not null").withColumn("_extra", F.col("_whole") * F.col("size"))
    order = W.partitionBy("_s", "_b").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ending = placed.where("_whole is null").withColumn("_run", F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn(
        "_extra", F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_run")))).drop("_run")
    return settled.unionByName(ending).select("doc_id", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_extra")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as the mix takes them: a row per whole epoch, and a row cut to the words of the last, partial one.

    Columns are those of ``docs``; n_chars follows the text. Repeated rows (equal doc_id and size) each give what the one
    of them that takes most takes. Rows that take nothing go, so texts without words go.
    """
    size, left, times = fresh(docs, "mix_size"), fresh(docs, "mix_taken"), fresh(docs, "mix_part")
    key, key_size = fresh(docs, "mix_doc"), fresh(docs, "mix_doc_size")
    taken = mixed.where("taken > 0").groupBy(F.col("doc_id").alias(key), F.col("size").alias(key_size)).agg(F.max("taken").alias(left))
    staged = docs.withColumn(size, size_of(F.col(text)))
    joined = staged.join(taken, F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(size) == F.col(key_size)))
    parts = joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.ceil(F.col(left) / F.col(size)).cast("int"))))
    words = F.least(F.col(size), F.col(left) - (F.col(times) - 1) * F.col(size))
    cut = F.when(words == F.col(size), F.col(text)).otherwise(F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), words.cast("int")), ""))
    out = {text: cut}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(cut).cast(dict(docs.dtypes)["n_chars"])
    return parts.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
