"""Identifier audits, digests, hash chains, sealed packages, replay and sign-off checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.identifiers import classify_anchor as anchor_of
from labelwright.functions.identifiers import classify_gtin
from labelwright.functions.ordering import bucketed_row_number
from labelwright.functions.sizing import broadcast_if_small

PACKAGE_VERSION = "2.0.0"


def audit_gtin(df: DataFrame, raw: str = "raw_value", symbology: str | None = "symbology") -> DataFrame:
    sym = F.col(symbology) if symbology else F.lit(None).cast("string")
    staged = df.withColumn("_g", classify_gtin(F.col(raw), sym))
    return staged.withColumn("gtin", F.col("_g.gtin")).withColumn("gtin_status", F.col("_g.status")).drop("_g")


def classify_anchors(df: DataFrame, col: str) -> DataFrame:
    staged = df.withColumn("_a", anchor_of(F.col(col)))
    return staged.withColumn("anchor_type", F.col("_a.anchor_type")).withColumn("anchor_status", F.col("_a.status")).drop("_a")


def status_profile(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


# ---- digests ------------------------------------------------------------------------------------

def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Compact JSON with sorted keys; NULLs are written, not dropped."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    staged = df.withColumn("_json", canonical_json(df, columns))
    return staged.withColumn("sha256", F.sha2("_json", 256)).withColumn("size", F.octet_length("_json")).drop("_json")


# ---- hash chains --------------------------------------------------------------------------------

def verify_chain(events: DataFrame, chain: str = "chain_id") -> DataFrame:
    """Findings over a hash-linked log ``(chain, event_id, canonical, previous_hash, event_hash)``.

    tampered: the hash is not that of the content; broken: the previous hash exists nowhere in the chain; fork: a
    hash is the predecessor of several events; roots: a chain has several first events. Links are found by an
    equi-join on the hash, so nothing is sorted globally and a long chain is spread by hash.
    """
    tampered = events.where(F.sha2("canonical", 256) != F.col("event_hash")).select(chain, "event_id", F.lit("tampered").alias("finding"))
    known = events.select(F.col(chain).alias("_c"), F.col("event_hash").alias("_h")).distinct()
    broken = (events.where("previous_hash is not null")
              .join(known, (F.col(chain) == F.col("_c")) & (F.col("previous_hash") == F.col("_h")), "left_anti")
              .select(chain, "event_id", F.lit("broken_link").alias("finding")))
    forks = (events.where("previous_hash is not null").groupBy(chain, "previous_hash").agg(F.count("*").alias("_n"), F.max("event_id").alias("event_id"))
             .where("_n > 1").select(chain, "event_id", F.lit("fork").alias("finding")))
    roots = (events.where("previous_hash is null").groupBy(chain).agg(F.count("*").alias("_n"), F.max("event_id").alias("event_id"))
             .where("_n > 1").select(chain, "event_id", F.lit("several_roots").alias("finding")))
    return tampered.unionByName(broken).unionByName(forks).unionByName(roots)


# ---- Merkle roots -------------------------------------------------------------------------------

def _hash_level(level: Column) -> Column:
    """One level up: neighbours joined and hashed, an odd last node paired with itself."""
    half = F.sequence(F.lit(0), (F.size(level) / 2 + 0.5).cast("int") - 1)
    left = lambda i: F.get(level, i * 2)
    right = lambda i: F.coalesce(F.get(level, i * 2 + 1), F.get(level, i * 2))
    return F.transform(half, lambda i: F.unhex(F.sha2(F.concat(left(i), right(i)), 256)))


def merkle_root(leaves: DataFrame, group: str, order: str, leaf: str, block_bits: int = 12, rounds: int = 1) -> DataFrame:
    """Root per group over ASCII-hex leaves in order; upper levels hash raw bytes; an odd level repeats its last node.

    A group of at most ``2**block_bits`` leaves is one block and is folded where it is gathered: its leaves move once, or
    not at all when they lie by group already. Leaves of larger groups are numbered exactly, then folded in blocks that
    line up with the tree, and the block nodes are folded again until the largest group is one node, in ``rounds`` at
    least. A block is the most a task ever holds of a group. Leaves without a group or place are left out.
    """
    size = 2 ** block_bits
    known = leaves.where(F.col(group).isNotNull() & F.col(order).isNotNull()).select(group, order, F.col(leaf).cast("string").alias("_leaf"))
    counts = known.groupBy(group).agg(F.count("*").alias("_n"))
    largest = counts.agg(F.max("_n")).first()[0] or 1
    if largest <= size:
        return _short_roots(known, group, order, block_bits)
    large = broadcast_if_small(counts.where(F.col("_n") > size).select(group))
    return _short_roots(known.join(large, group, "left_anti"), group, order, block_bits).unionByName(
        _long_roots(known.join(large, group, "left_semi"), group, order, block_bits, max(rounds, -(-(largest - 1).bit_length() // block_bits))))


def _short_roots(leaves: DataFrame, group: str, order: str, block_bits: int) -> DataFrame:
    held = leaves.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.encode("_leaf", "utf-8").alias("_node")))).alias("_l"))
    root = _fold_block(F.transform("_l", lambda x: x["_node"]), block_bits, F.lit(False))
    return held.select(group, F.lower(F.hex(root)).alias("merkle_root"))


def _long_roots(leaves: DataFrame, group: str, order: str, block_bits: int, rounds: int) -> DataFrame:
    size = 2 ** block_bits
    numbered = bucketed_row_number(leaves, [group], [F.col(order)], _order_bucket(leaves, order), "_n")
    nodes = numbered.select(group, (F.col("_n") - 1).alias("_i"), F.encode("_leaf", "utf-8").alias("_node"))
    nodes = nodes.join(nodes.groupBy(group).agg(F.count("*").alias("_total")), group)
    for _ in range(rounds):
        blocks = nodes.groupBy(group, F.floor(F.col("_i") / size).alias("_b")).agg(
            F.array_sort(F.collect_list(F.struct("_i", "_node"))).alias("_l"), F.first("_total").alias("_t"))
        folded = _fold_block(F.transform("_l", lambda x: x["_node"]), block_bits, F.col("_t") > size)
        nodes = blocks.select(group, F.col("_b").alias("_i"), folded.alias("_node"), F.ceil(F.col("_t") / size).alias("_total"))
    return nodes.select(group, F.lower(F.hex("_node")).alias("merkle_root"))


def _fold_block(nodes: Column, block_bits: int, climb: Column) -> Column:
    """Fold a block to one node. When the group has further blocks, a short last block climbs every level, pairing
    its only node with itself, as the odd end of the whole level does; a lone block stops at one node."""
    step = lambda level, _i: F.when((F.size(level) > 1) | climb, _hash_level(level)).otherwise(level)
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(block_bits)), nodes, step), F.lit(0))


def _order_bucket(df: DataFrame, order: str) -> Column:
    """A coarse bucket that does not decrease with the order column."""
    kind = dict(df.dtypes)[order]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.shiftright(F.col(order).cast("bigint"), 12)
    if kind in ("double", "float"):
        return F.when(F.isnan(order), F.lit(2 ** 63 - 1)).otherwise(F.floor(order))
    if kind.startswith("decimal"):
        return F.floor(order)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.date_trunc("hour", F.col(order))
    if kind == "string":
        return F.substring(F.col(order), 1, 6)
    raise ValueError(f"no bucket keeps the order of {kind}")


def package_digest(evidence_id: Column, ruleset_digest: Column, model_digests: Column) -> Column:
    body = F.to_json(F.struct(evidence_id.alias("evidence_id"), model_digests.alias("model_digests"),
                              F.lit(PACKAGE_VERSION).alias("package_version"), ruleset_digest.alias("ruleset_digest")), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def seal_packages(packages: DataFrame, artifacts: DataFrame, block_bits: int = 12) -> DataFrame:
    """Root over the package digest and the artifact digests in order; the package id follows from the root.

    ``packages(package_key, evidence_id, ruleset_digest, model_digests map)``, ``artifacts(package_key, artifact_id,
    artifact_digest)``. The package digest is the first leaf.
    """
    head = packages.select("package_key", F.lit(-1).cast("bigint").alias("artifact_id"),
                           package_digest(F.col("evidence_id"), F.col("ruleset_digest"), F.col("model_digests")).alias("artifact_digest"))
    leaves = head.unionByName(artifacts.select("package_key", F.col("artifact_id").cast("bigint").alias("artifact_id"), "artifact_digest"))
    roots = merkle_root(leaves, "package_key", "artifact_id", "artifact_digest", block_bits)
    return roots.withColumn("package_id", F.concat(F.lit("evidence-"), F.substring(F.sha2("merkle_root", 256), 1, 16)))


def tampered(manifest: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest entries whose artifact is missing now or has another digest."""
    now = current.select(*keys, F.col("sha256").alias("_now"))
    return manifest.join(now, keys, "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).select(
        *keys, F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("change"))


def verify_packages(sealed: DataFrame, packages: DataFrame, artifacts: DataFrame, changes: DataFrame) -> DataFrame:
    """Recompute the seal: changed artifacts, root and id of each stored package."""
    fresh = seal_packages(packages, artifacts).select("package_key", F.col("merkle_root").alias("_root"), F.col("package_id").alias("_id"))
    n = changes.groupBy("package_key").agg(F.count("*").alias("_changed"))
    j = sealed.join(fresh, "package_key", "left").join(n, "package_key", "left")
    changed, root_ok, id_ok = F.coalesce("_changed", F.lit(0)), F.col("merkle_root").eqNullSafe(F.col("_root")), F.col("package_id").eqNullSafe(F.col("_id"))
    problems = F.array_compact(F.array(F.when(changed > 0, "artifacts"), F.when(~root_ok & (changed == 0), "package_manifest"), F.when(~id_ok, "package_id")))
    return j.select("package_key", changed.alias("changed_artifacts"), (F.size(problems) == 0).alias("valid"), F.array_join(problems, ",").alias("problems"))


# ---- replay, submission, sign-off -----------------------------------------------------------------

def replay_safe(records: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Whether a record's key was seen before, in the store or earlier in the batch, and its first record."""
    stored = existing.groupBy(key).agg(F.min(order).alias("_stored"))
    first = records.groupBy(key).agg(F.min(order).alias("_first"))
    j = records.join(first, key).join(stored, key, "left")
    prior = F.coalesce("_stored", F.when(F.col(order) > F.col("_first"), F.col("_first")))
    return j.select(key, order, prior.isNotNull().alias("duplicate"), prior.alias("first_record"))


def submission_payload(packages: DataFrame, max_artifacts: int | None = None) -> DataFrame:
    """``(package_key, package_id, evidence_id, merkle_root, artifact_hashes map)`` to a validated payload with a
    digest and a stable key."""
    hexed = lambda c: c.rlike("^[0-9a-fA-F]{64}$")
    hashes = F.map_from_entries(F.array_sort(F.map_entries("artifact_hashes")))
    root_ok = F.col("merkle_root").isNull() | hexed(F.col("merkle_root"))
    too_many = F.lit(False) if max_artifacts is None else F.size("artifact_hashes") > max_artifacts
    problem = (F.when(too_many, "too_many_artifacts")
               .when(~F.forall(F.map_values("artifact_hashes"), hexed) | F.exists(F.map_keys("artifact_hashes"), lambda k: F.length(k) == 0), "artifact_hash")
               .when(~root_ok, "merkle_root").when(F.col("package_id").isNull() & F.col("evidence_id").isNull(), "identifier"))
    body = F.to_json(F.struct(hashes.alias("artifact_hashes"), "evidence_id", F.col("package_id").alias("evidence_package_id"),
                              F.lower("merkle_root").alias("merkle_root"), F.lit(1).alias("schema_version")), {"ignoreNullFields": "false"})
    staged = packages.withColumn("problem", problem).withColumn("payload_sha256", F.when(F.col("problem").isNull(), F.sha2(body, 256)))
    stable = F.sha2(F.concat_ws(":", F.coalesce("package_id", "evidence_id"), F.col("payload_sha256")), 256)
    return staged.select("package_key", F.when(F.col("problem").isNull(), "ready").otherwise("validation_failure").alias("status"), "problem",
                         "payload_sha256", F.when(F.col("problem").isNull(), stable).alias("idempotency_key"))


def signoff_check(signoffs: DataFrame, packages: DataFrame) -> DataFrame:
    """What keeps a sign-off from being accepted, first reason first."""
    stored = packages.select("package_id", F.col("merkle_root").alias("_stored"))
    blank = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
    j = signoffs.join(stored, "package_id", "left")
    problem = (F.when(blank("reviewer_id"), "reviewer").when(blank("package_id"), "package").when(blank("merkle_root"), "root")
               .when(F.col("_stored").isNotNull() & (F.col("_stored") != F.col("merkle_root")), "root_mismatch").when(blank("decision"), "decision"))
    return j.select("signoff_id", "package_id", problem.alias("problem"), problem.isNull().alias("accepted"))


def insert_if_absent(new: DataFrame, target: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rows to reject: a key already stored, or repeated in the batch, is never overwritten."""
    carried = [c for c in new.columns if c != key]
    firsts = new.groupBy(key).agg(F.min(F.struct(*carried)).alias("_f"), F.count("*").alias("_n"))
    fresh = firsts.join(target.select(key).distinct(), key, "left_anti")
    accepted = fresh.select(key, "_f.*").select(*new.columns)
    stored = firsts.join(target.select(key).distinct(), key, "left_semi")
    rejected = stored.select(key, F.col("_n").alias("rejected"), F.lit("exists").alias("reason")).unionByName(
        fresh.where("_n > 1").select(key, (F.col("_n") - 1).alias("rejected"), F.lit("repeated").alias("reason")))
    return accepted, rejected
