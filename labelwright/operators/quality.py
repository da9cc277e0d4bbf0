"""Dataset checks: class balance, distributions, duplicates, leakage, manifests, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.sizing import broadcast_if_small


def class_balance(labels: DataFrame, splits: list[str], classes: list[int]) -> DataFrame:
    """Instances per split and class, zeros included; one aggregate of split × class counters."""
    counts = labels.groupBy("class_id").pivot("split", splits).agg(F.count(F.lit(1)))
    spark = labels.sparkSession
    every = spark.createDataFrame([(c,) for c in classes], "class_id int")
    joined = every.join(counts, "class_id", "left")
    return joined.select("class_id", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in splits])


def zero_classes(balance: DataFrame, splits: list[str]) -> DataFrame:
    """(split, class) pairs without instances."""
    long = balance.select("class_id", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in splits])).alias("r"))
    return long.where("r.n = 0").select("r.split", "class_id")


def dataset_report(images: DataFrame, dimensions: list[str], conditions: str) -> DataFrame:
    """Counts by every dimension and by exploded condition, in one pass of grouping sets over one scan."""
    plain = images.select(*[F.col(d).cast("string").alias(d) for d in dimensions], F.array_distinct(conditions).alias("_c"))
    pairs = F.concat(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]),
                     F.transform("_c", lambda c: F.struct(F.lit("condition").alias("dimension"), c.alias("value"))))
    return plain.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def with_digest(df: DataFrame, content: str, out: str = "digest") -> DataFrame:
    return df.withColumn(out, F.sha2(F.col(content), 256))


def exact_duplicates(images: DataFrame, key: str = "image_id") -> DataFrame:
    """Digest groups with more than one image: across splits an error, within one split a warning.

    Only counts, the smallest id and the set of (few) splits travel; the members of a group are found by joining
    back on the digest when they are wanted.
    """
    groups = images.groupBy("digest").agg(F.count("*").alias("copies"), F.min(key).alias("first_image"),
                                          F.array_sort(F.collect_set("split")).alias("_splits"))
    return groups.where("copies > 1").select(
        "digest", "copies", "first_image", F.array_join("_splits", ",").alias("splits"),
        F.when(F.size("_splits") > 1, "leakage").otherwise("duplicate").alias("severity"))


def duplicate_members(images: DataFrame, groups: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(groups.select("digest", "severity"), "digest").select(key, "split", "digest", "severity")


def identity_leakage(images: DataFrame, identity: str) -> DataFrame:
    """Identities seen in more than one split; the set of splits is small."""
    return (images.groupBy(identity).agg(F.count("*").alias("images"), F.array_sort(F.collect_set("split")).alias("_s"))
            .where(F.size("_s") > 1).select(identity, "images", F.array_join("_s", ",").alias("splits")))


def split_manifest(images: DataFrame, key: str = "image_id", buckets: int = 4096) -> DataFrame:
    """Per split: images, labelled images and a digest that depends on content only.

    Rows are hashed, ordered inside hash buckets, and the ordered bucket digests are hashed per split. No task
    sees more than one bucket of a split, and the result does not depend on row order or partitioning.
    """
    line = F.sha2(F.concat_ws("|", F.col(key).cast("string"), "digest", F.coalesce("label_digest", F.lit(""))), 256)
    rows = images.select("split", line.alias("_h"), F.col("label_digest").isNotNull().alias("_l"))
    bucket = F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") % buckets
    per_bucket = rows.groupBy("split", bucket.alias("_b")).agg(
        F.count("*").alias("_n"), F.count_if("_l").alias("_labelled"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), "\n"), 256).alias("_d"))
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_d"))), lambda r: r["_d"]), "\n"), 256)
    return per_bucket.groupBy("split").agg(F.sum("_n").alias("images"), F.sum("_labelled").alias("labelled"), digest.alias("manifest")).withColumn(
        "status", F.when(F.col("images") > 0, "present").otherwise("unavailable"))


def referential_gaps(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows whose reference is set but points nowhere."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("_pk")).distinct(), F.col(fk) == F.col("_pk"), "left_anti")


def images_vs_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images without a label file and label files without an image, by split and stem."""
    keys = ["split", "stem"]
    unlabelled = images.select(*keys).join(labels.select(*keys), keys, "left_anti").withColumn("problem", F.lit("unlabelled"))
    orphans = labels.select(*keys).join(images.select(*keys), keys, "left_anti").withColumn("problem", F.lit("orphan_label"))
    return unlabelled.unionByName(orphans)


def label_path_of(image_path: Column) -> Column:
    """The last ``images`` path segment becomes ``labels``."""
    return F.regexp_replace(image_path, r"^(.*/)?images/(?!.*/?images/)", "$1labels/")


def provenance_check(images: DataFrame, provenance: DataFrame) -> DataFrame:
    """Image against provenance on (split, image): what is missing or disagrees."""
    p = provenance.select("split", "image", F.col("image_digest").alias("_pd"), F.col("label_digest").alias("_pl"),
                          F.col("object_count").alias("_pc"), F.lit(True).alias("_has_p"))
    j = images.withColumn("_has_i", F.lit(True)).join(p, ["split", "image"], "full_outer")
    problem = (F.when(F.col("_has_i").isNull(), "extra_metadata").when(F.col("_has_p").isNull(), "no_provenance")
               .when(~F.col("digest").eqNullSafe(F.col("_pd")) | ~F.col("label_digest").eqNullSafe(F.col("_pl")), "digest_mismatch")
               .when(F.col("label_digest").isNull(), "no_annotation").when(F.col("objects") != F.col("_pc"), "count_mismatch"))
    return j.withColumn("problem", problem).where("problem is not null").select("split", "image", "problem")


def known_rule(findings: DataFrame, rules: DataFrame, known: bool = True) -> DataFrame:
    return findings.join(broadcast_if_small(rules.select("rule_id").distinct()), "rule_id", "left_semi" if known else "left_anti")
