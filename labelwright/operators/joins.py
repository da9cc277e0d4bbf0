"""Record comparison and linkage: queue identities, label against listing, registry, box matching, legal basis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions import measures as M
from labelwright.functions.sizing import broadcast_if_small
from labelwright.functions.text import blank_to_null, fold, let
from labelwright.operators.filters import clean_detections
from labelwright.session import cut_lineage

COMPARED_FIELDS = {"net_quantity": "net_quantity", "country_of_origin": "country_of_origin",
                   "manufacturer_packer_importer_details": "manufacturer", "maximum_retail_price_mrp": "mrp"}
QUANTITY_TOLERANCE = 0.005


def queue_with_identity(revisions: DataFrame, users: DataFrame) -> DataFrame:
    """Queue rows with the identity of their manufacturer; a missing one gets defaults."""
    u = users.select(F.col("user_id").alias("_u"), F.col("full_name").alias("_n"), F.col("company").alias("_c"), F.col("email").alias("_e"))
    j = revisions.join(u, F.col("manufacturer_id") == F.col("_u"), "left")
    return j.withColumn("manufacturer_name", F.coalesce("_n", F.lit("Unknown"))).withColumn(
        "manufacturer_company", F.coalesce("_c", F.lit(""))).withColumn("manufacturer_email", F.coalesce("_e", F.lit(""))).drop("_u", "_n", "_c", "_e")


# ---- label against listing ------------------------------------------------------------------------

def compare_quantity(a: Column, b: Column) -> Column:
    left, right = M.quantity_amount(a), M.quantity_amount(b)
    usable = left.isNotNull() & right.isNotNull() & (M.quantity_basis(a) == M.quantity_basis(b)) & (left != 0)
    return F.when(~F.coalesce(usable, F.lit(False)), "REVIEW_REQUIRED").when(
        F.abs(left - right) / left <= QUANTITY_TOLERANCE, "MATCH").otherwise("MISMATCH")


def compare_country(a: Column, b: Column) -> Column:
    left, right = M.comparable_country(a), M.comparable_country(b)
    return F.when((F.length(left) == 0) | (F.length(right) == 0), "REVIEW_REQUIRED").when(left == right, "MATCH").otherwise("MISMATCH")


def listed_amount(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, ",", ""), r"[0-9]+(?:\.[0-9]{1,2})?", 0).try_cast("double")


def compare_price(a: Column, b: Column) -> Column:
    left, right = listed_amount(a), listed_amount(b)
    return F.when(left.isNull() | right.isNull(), "REVIEW_REQUIRED").when(F.abs(left - right) <= 0.01, "MATCH").otherwise("MISMATCH")


def compare_maker(a: Column, b: Column) -> Column:
    """Containment either way is a match; other wording is for a person to judge, never a mismatch."""
    left, right = fold(a), fold(b)
    blank = (F.length(left) == 0) | (F.length(right) == 0)
    return F.when(~blank & (left.contains(right) | right.contains(left)), "MATCH").otherwise("REVIEW_REQUIRED")


def compare_records(physical: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per document and compared field. ``physical(doc_id, field, value)``,
    ``listing(doc_id, retrieval_status, mrp, net_quantity, country_of_origin, manufacturer, packer_importer)``.

    The physical side is folded to one row per document with a conditional aggregate, so each side is
    shuffled once, whatever the number of fields.
    """
    wide = physical.where(F.col("field").isin(*COMPARED_FIELDS)).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field") == f, blank_to_null(F.col("value")))).alias(f"_p_{f}") for f in COMPARED_FIELDS])
    j = listing.where("retrieval_status = 'SUCCESS'").join(wide, "doc_id", "left")
    test = {"net_quantity": compare_quantity, "country_of_origin": compare_country,
            "manufacturer_packer_importer_details": compare_maker, "maximum_retail_price_mrp": compare_price}
    rows = []
    for field, listed in COMPARED_FIELDS.items():
        p = F.col(f"_p_{field}")
        found = blank_to_null(F.col(listed))
        if field == "manufacturer_packer_importer_details":
            found = F.coalesce(found, blank_to_null(F.col("packer_importer")))
        outcome = (F.when(p.isNull() & found.isNull(), "NOT_APPLICABLE").when(p.isNull(), "PHYSICAL_FIELD_UNAVAILABLE")
                   .when(found.isNull(), "LISTING_FIELD_UNAVAILABLE").otherwise(test[field](p, found)))
        rows.append(F.struct(F.lit(field).alias("field"), p.alias("physical_value"), found.alias("listing_value"), outcome.alias("outcome")))
    return j.select("doc_id", F.inline(F.array(*rows)))


def comparison_counts(comparisons: DataFrame) -> DataFrame:
    return comparisons.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "MISMATCH").alias("mismatches"),
                                             F.count_if(F.col("outcome") == "REVIEW_REQUIRED").alias("reviews"))


# ---- registry ---------------------------------------------------------------------------------------

def registry_lookup(barcodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Each distinct valid GTIN is looked up once; rows then take the result. ``barcodes`` come from ``audit_gtin``."""
    wanted = barcodes.where("gtin is not null").select("gtin").distinct()
    looked = wanted.join(registry.withColumn("_found", F.lit(True)), "gtin", "left").withColumnRenamed("gtin", "_g")
    j = barcodes.join(looked, F.col("gtin") == F.col("_g"), "left").drop("_g")
    status = F.when(F.col("gtin").isNull(), "NOT_ATTEMPTED").when(F.col("_found"), "VERIFIED").otherwise("NOT_FOUND")
    return j.withColumn("lookup_status", status).drop("_found")


def comparison_text(c: Column, joined_units: bool = False) -> Column:
    words = F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    return F.nullif(F.regexp_replace(words, r"(?<=\d)\s+(?=[a-z])", "") if joined_units else words, F.lit(""))


def identity_compare(rows: DataFrame, pairs: dict[str, tuple[str, str]], verified: Column) -> DataFrame:
    """Per row and identity field: CONSISTENT, MISMATCH or NOT_AVAILABLE. ``pairs``: field to (label, registry) columns."""
    def state(field: str, a: str, b: str) -> Column:
        left, right = comparison_text(F.col(a), field == "net_content"), comparison_text(F.col(b), field == "net_content")
        value = (F.when(~F.coalesce(verified, F.lit(False)) | left.isNull() | right.isNull(), "NOT_AVAILABLE")
                 .when(left == right, "CONSISTENT").otherwise("MISMATCH"))
        return F.struct(F.lit(field).alias("field"), value.alias("state"))
    return rows.withColumn("states", F.array(*[state(f, a, b) for f, (a, b) in pairs.items()]))


def identity_rollup(compared: DataFrame, key: str) -> DataFrame:
    """A mismatch anywhere dominates; else verified, locally valid, unreadable."""
    mismatch = F.exists("states", lambda s: s["state"] == "MISMATCH")
    status = (F.when(F.bool_or(mismatch), "REVIEW_REQUIRED").when(F.bool_or(F.col("lookup_status") == "VERIFIED"), "EXTERNAL_VERIFIED_SUPPORTING")
              .when(F.bool_or(F.col("gtin").isNotNull()), "LOCAL_VALIDATION_ONLY").otherwise("IDENTIFIER_REVIEW_REQUIRED"))
    return compared.groupBy(key).agg(status.alias("status"), F.count("*").alias("barcodes"))


# ---- box matching -----------------------------------------------------------------------------------

def _overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def iou(a: Column, b: Column) -> Column:
    inter = _overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * _overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def geometry_score(a: Column, b: Column) -> Column:
    """IoU, raised for containment in both directions and for boxes side by side on one line."""
    side = lambda r, lo, hi: F.greatest(F.lit(1), r[hi] - r[lo])
    share = lambda lo, hi: F.least(F.lit(1.0), _overlap(a[lo], a[hi], b[lo], b[hi]) / F.least(side(a, lo, hi), side(b, lo, hi)))
    contained = share("y1", "y2") * share("x1", "x2")
    tall = F.greatest(side(a, "y1", "y2"), side(b, "y1", "y2"))
    centre = F.abs((a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2)
    gap = F.greatest(F.lit(0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))
    same_line = (centre <= tall * 0.5) & (gap <= tall * 0.5)
    return let(iou(a, b), lambda v: F.when(contained >= 0.5, F.greatest(v, contained * 0.7)).otherwise(
        F.greatest(v, F.when(same_line, 0.5).otherwise(0.0))))


def level(a: Column, b: Column) -> Column:
    """Whether boxes overlap in height or have their centres on one line; the geometry score of others is 0."""
    tall = F.greatest(F.lit(1), a["y2"] - a["y1"], b["y2"] - b["y1"])
    return (F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"])) | (F.abs((a["y1"] + a["y2"]) / 2 - (b["y1"] + b["y2"]) / 2) <= tall * 0.5)


def text_similarity(a: Column, b: Column) -> Column:
    return let(F.struct(fold(a).alias("l"), fold(b).alias("r")), lambda s: folded_similarity(s["l"], s["r"]))


def folded_similarity(left: Column, right: Column) -> Column:
    """``text_similarity`` of texts that are folded already."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(left == right, 1.0).when((F.length(left) == 0) | (F.length(right) == 0), 0.0).otherwise(
        1.0 - F.levenshtein(left, right) / longer)


def fused(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """Coordinate weighted by confidence."""
    return F.bround((a * wa + b * wb) / (wa + wb), 0).cast("int")


def candidate_pairs(a: DataFrame, b: DataFrame, image: str = "image_id", minimum: float = 0.45, band: int = 64) -> DataFrame:
    """Pairs whose geometry score reaches the minimum.

    Any such pair overlaps, or its centres are no further apart than half the taller side; a side counts as 1 at least.
    So the boxes, the flat ones made 1 tall, share a horizontal band. Boxes are joined per (image, band) and a pair is
    kept in its first common band only. Pairs that are neither are told by their heights alone and not scored.
    """
    def banded(df: DataFrame, side: str) -> DataFrame:
        centre = (F.col("y1") + F.col("y2")) / 2
        first, last = F.floor(F.least(F.col("y1"), centre - 0.5) / band), F.floor(F.greatest(F.col("y2"), centre + 0.5) / band)
        box = F.struct("pos", "text", "confidence", "x1", "y1", "x2", "y2")
        return df.select(image, box.alias(side), first.alias(f"_f{side}"), F.explode(F.sequence(first, last)).alias("_band"))
    j = banded(a, "a").join(banded(b, "b"), [image, "_band"]).where(F.col("_band") == F.greatest("_fa", "_fb"))
    seen = (F.col("a.confidence") > 0) | (F.col("b.confidence") > 0)
    score = geometry_score(F.col("a"), F.col("b"))
    if minimum > 0:
        score = F.when(level(F.col("a"), F.col("b")), score)
    scored = j.where(seen).withColumn("score", score)
    return scored.where(F.col("score") >= minimum).select(image, "a", "b", "score")


def dominant_pairs(pairs: DataFrame, image: str = "image_id") -> DataFrame:
    """One-to-one choice among ``pairs(image, l, r, score)``: what taking the best free pair again and again, by (score,
    l, r) from the top, would choose.

    A pair that is the best of both its boxes is taken in any case, so all of those are taken at once and the pairs of
    their boxes go; the rest is looked at again. Every step works per box, none gathers an image. There are as many
    rounds as the longest chain of pairs, each better than the next and sharing a box with it; each is written down.
    """
    left, right = W.partitionBy(image, "l"), W.partitionBy(image, "r")
    taken, free = [], pairs.select(image, "l", "r", "score")
    while True:
        best = ((F.row_number().over(left.orderBy(F.desc("score"), F.desc("r"))) == 1) & (F.row_number().over(right.orderBy(F.desc("score"), F.desc("l"))) == 1))
        flagged = free.withColumn("_taken", best).withColumn("_gone", F.bool_or("_taken").over(right)).withColumn("_gone", F.col("_gone") | F.bool_or("_taken").over(left))
        step = cut_lineage(flagged.where("_taken or not _gone").select(image, "l", "r", "score", "_taken"))
        taken.append(step.where("_taken").drop("_taken"))
        free = step.where("not _taken").drop("_taken")
        if free.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def match_boxes(a: DataFrame, b: DataFrame, image: str = "image_id", minimum: float = 0.45, band: int = 64, cap: int | None = None) -> DataFrame:
    """One row per matched pair or single box: the greedy one-to-one matching of two readings of an image.

    ``left_pos, right_pos, status, text, confidence, other_text, other_confidence, iou, score, text_similarity`` and the
    box. The left reading is the authority: its text and confidence stand where it has the box; the box of a pair is
    weighted by confidence. ``status``: consensus, disagreement, single_source (left alone), other_only (right alone).
    Both readings are cleaned and written once; ``cap`` keeps so many boxes per image where a caller wants that.
    """
    kept = ["pos", "text", "confidence", "x1", "y1", "x2", "y2"]
    sides = [clean_detections(df, cap).select(image, *kept, F.lit(i).alias("_side")) for i, df in enumerate((a, b))]
    boxes = cut_lineage(sides[0].unionByName(sides[1]))
    a, b = (boxes.where(F.col("_side") == i).drop("_side") for i in (0, 1))
    bare = lambda df: df.withColumn("text", F.lit(None).cast("string"))
    pairs = candidate_pairs(bare(a), bare(b), image, minimum, band).select(image, F.col("a.pos").alias("l"), F.col("b.pos").alias("r"), "score")
    picked = dominant_pairs(cut_lineage(pairs), image)
    left = a.select(image, F.col("pos").alias("l"), F.struct(*kept[1:]).alias("a"))
    right = b.select(image, F.col("pos").alias("r"), F.struct(*kept[1:]).alias("b"))
    full = left.join(picked, [image, "l"], "left").join(right, [image, "r"], "full_outer")
    full = full.withColumn("_fa", fold(F.col("a.text"))).withColumn("_fb", fold(F.col("b.text")))
    same = F.col("_fa") == F.col("_fb")
    status = (F.when(F.col("a").isNull(), "other_only").when(F.col("b").isNull(), "single_source")
              .when(same, "consensus").otherwise("disagreement"))
    wa, wb = F.greatest(F.col("a.confidence"), F.lit(0.01)), F.greatest(F.col("b.confidence"), F.lit(0.01))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    coord = lambda c: F.when(both, fused(F.col(f"a.{c}"), F.col(f"b.{c}"), wa, wb)).otherwise(F.coalesce(f"a.{c}", f"b.{c}")).alias(c)
    return full.select(image, F.col("l").alias("left_pos"), F.col("r").alias("right_pos"), status.alias("status"), F.coalesce("a.text", "b.text").alias("text"),
                       F.coalesce("a.confidence", "b.confidence").alias("confidence"), F.when(both, F.col("b.text")).alias("other_text"), F.when(both, F.col("b.confidence")).alias("other_confidence"),
                       F.when(both, F.round(iou(F.col("a"), F.col("b")), 6)).alias("iou"), F.round("score", 4).alias("score"),
                       F.when(both, F.round(folded_similarity(F.col("_fa"), F.col("_fb")), 4)).alias("text_similarity"),
                       *[coord(c) for c in ("x1", "y1", "x2", "y2")])


def disagreements(matched: DataFrame, image: str = "image_id") -> DataFrame:
    """What a person must look at: pairs of unlike text and boxes that only the second reading has."""
    pair = F.col("status") == "disagreement"
    return matched.where(pair | (F.col("status") == "other_only")).select(
        image, "left_pos", "right_pos", F.lit("review_required").alias("status"), F.when(pair, F.col("text")).alias("left_text"), F.when(pair, F.col("confidence")).alias("left_confidence"),
        F.when(pair, F.col("other_text")).otherwise(F.col("text")).alias("right_text"), F.when(pair, F.col("other_confidence")).otherwise(F.col("confidence")).alias("right_confidence"),
        "score", "text_similarity", "x1", "y1", "x2", "y2")


def ensemble_summary(matched: DataFrame, images: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """Mode, regions, disagreements and status of each image; those of ``images`` without any box are ``no_data``."""
    any_left, any_right = F.bool_or(F.col("left_pos").isNotNull()), F.bool_or(F.col("right_pos").isNotNull())
    n = F.count_if(F.col("status").isin("disagreement", "other_only"))
    mode = F.when(any_left & any_right, "comparison_review_only").when(any_left, "primary_only").otherwise("secondary_only_review")
    found = matched.groupBy(image).agg(mode.alias("mode"), F.count("*").alias("regions"), n.alias("disagreements"))
    if images is not None:
        found = images.select(image).distinct().join(found, image, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return found.select(image, F.coalesce("mode", F.lit("no_data")).alias("mode"), zero("regions"), zero("disagreements"), F.when(F.col("disagreements") > 0, "review_required").otherwise("ok").alias("status"))


# ---- legal basis ------------------------------------------------------------------------------------

def legal_basis(findings: DataFrame, provisions: DataFrame, sources: DataFrame, as_of: Column,
                blocked: list[str], unresolved: list[str]) -> DataFrame:
    """Provisions in force for each finding ``(finding_id, rule_id, field)`` at a date, or why there is none."""
    def current(prefix: str = "") -> Column:
        return (F.coalesce(F.col(f"{prefix}effective_from"), as_of) <= as_of) & (F.coalesce(F.col(f"{prefix}effective_until"), as_of) >= as_of)
    usable = sources.where(~F.coalesce("verification_status", F.lit("")).isin("unresolved", "blocked") & current()).select(F.col("source_id").alias("_s"))
    live = provisions.where(F.col("is_currently_effective") & current()).join(usable, F.col("source_id") == F.col("_s"), "left_semi")
    # Findings may be many and provisions of one rule few: per (rule, field) a count and the first id suffice.
    per_field = live.groupBy("linked_rule_id", "linked_field").agg(F.count("*").alias("_n"), F.min("provision_id").alias("_first"))
    j = findings.join(broadcast_if_small(per_field), (F.col("rule_id") == F.col("linked_rule_id")) & (
        F.col("field").isNull() | (F.col("field") == F.col("linked_field"))), "left")
    agg = j.groupBy("finding_id", "rule_id", "field").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.min("_first").alias("_first"))
    barred = F.when(F.col("field").isin(*blocked), "legal_source_blocked").when(F.col("field").isin(*unresolved), "legal_source_unresolved")
    reason = F.coalesce(barred, F.when(F.col("_n") == 0, "not_in_verified_corpus"))
    return agg.select("finding_id", "rule_id", "field", F.when(reason.isNull(), "found").otherwise("not_available").alias("status"), reason.alias("reason"),
                      F.when(reason.isNull(), F.col("_n")).otherwise(0).cast("bigint").alias("provisions"), F.when(reason.isNull(), F.col("_first")).alias("first_provision"))


# ---- calibrations, artifacts, first-seen --------------------------------------------------------------

def agreement_pairs(calibrations: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Disagreeing calibrations of one image: those that differ by more than sigma combined uncertainties.

    ``(image_id, pos, scale, uncertainty)``. The extremes of an image decide first whether it can hold a
    disagreement at all; images that agree never reach the join.
    """
    span = calibrations.groupBy("image_id").agg(F.min("scale").alias("_lo"), F.max("scale").alias("_hi"), F.min("uncertainty").alias("_u"))
    suspects = span.where((F.col("_hi") - F.col("_lo")) > sigma * F.hypot("_u", "_u")).select("image_id")
    some = calibrations.join(suspects, "image_id", "left_semi")
    a = some.select("image_id", F.col("pos").alias("first_pos"), F.col("scale").alias("_s1"), F.col("uncertainty").alias("_u1"))
    b = some.select(F.col("image_id").alias("_i"), F.col("pos").alias("second_pos"), F.col("scale").alias("_s2"), F.col("uncertainty").alias("_u2"))
    gap = F.abs(F.col("_s1") - F.col("_s2"))
    allowed = F.lit(sigma) * F.hypot("_u1", "_u2")
    j = a.join(b, (F.col("image_id") == F.col("_i")) & (F.col("first_pos") < F.col("second_pos")) & (gap > allowed))
    return j.select("image_id", "first_pos", "second_pos", gap.alias("difference"), allowed.alias("allowed"))


def calibration_agreement(calibrations: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Whether the calibrations of an image agree; fewer than two, or a missing uncertainty, go to review."""
    bad = agreement_pairs(calibrations, sigma).groupBy("image_id").agg(F.count("*").alias("_d"))
    n = calibrations.groupBy("image_id").agg(F.count("*").alias("_n"), F.count_if((F.col("scale") > 0) & (F.col("uncertainty") >= 0)).alias("_ok"))
    j = n.join(bad, "image_id", "left")
    fine = (F.col("_n") >= 2) & (F.col("_ok") == F.col("_n")) & F.col("_d").isNull()
    return j.select("image_id", F.when(fine, "REFERENCES_AGREE_REVIEW_ONLY").otherwise("REVIEW_REQUIRED").alias("status"), F.coalesce("_d", F.lit(0)).alias("disagreements"))


def with_parent(artifacts: DataFrame, packages: DataFrame) -> DataFrame:
    """Artifacts with the package they belong to; one without a package keeps its row."""
    return artifacts.join(packages.select("package_key", "package_id"), "package_key", "left")


def flatten_first_seen(results: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first rule that speaks about a field wins."""
    carried = [c for c in results.columns if c not in key]
    return results.groupBy(*key).agg(F.min_by(F.struct(*carried), order).alias("_v")).select(*key, "_v.*")
