"""Box geometry: pixel measurements, legibility, crops, physical scale, panel coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.geometry_checks import finite
from labelwright.functions.text import all_of, let

# How many millimetres one unit is, and the geometry limits.
UNIT_MM = {"mm": 1.0, "millimeter": 1.0, "millimeters": 1.0, "cm": 10.0, "centimeter": 10.0, "centimeters": 10.0,
           "m": 1000.0, "meter": 1000.0, "meters": 1000.0, "in": 25.4, "inch": 25.4, "inches": 25.4}
MAX_DISTORTION = 0.30
MIN_COVERAGE = 0.30


def bounds(polygon: Column) -> Column:
    """Bounding box of an array of ``[x, y]`` points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
                    F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def pixel_geometry(boxes: DataFrame, unit: str = "mm") -> DataFrame:
    """Width and height of boxes ``(x1,y1,x2,y2, scale_px_per_mm, uncertainty_px)``; no scale means review."""
    per_unit = UNIT_MM.get(unit)
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    valid = all_of([finite(F.col(c).cast("double")) for c in ("x1", "y1", "x2", "y2")]) & (width > 0) & (height > 0)
    if unit in ("px", "pixel", "pixels"):
        divisor, usable = F.lit(1.0), valid
    else:
        divisor = F.when(F.col("scale_px_per_mm") > 0, F.col("scale_px_per_mm")) * F.lit(per_unit)
        usable = valid & divisor.isNotNull()
    return boxes.select(
        "doc_id", "pos", F.when(usable, "experimental_measurement").otherwise("review_required").alias("status"),
        F.when(usable, F.round(width / divisor, 4)).alias("width"), F.when(usable, F.round(height / divisor, 4)).alias("height"),
        F.when(usable, F.round(F.col("uncertainty_px") / divisor, 4)).alias("bound"),
        F.when(~valid, "invalid_geometry_or_quality").when(~usable, "validated_physical_calibration_unavailable").alias("reason"))


def edges(polygon: Column) -> Column:
    """Lengths of the four edges of a quadrilateral."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.hypot(
        F.get(polygon, (i + 1) % 4)[0] - F.get(polygon, i)[0], F.get(polygon, (i + 1) % 4)[1] - F.get(polygon, i)[1]))


def turns(polygon: Column) -> Column:
    """Cross products at the corners; all of one sign for a convex quadrilateral."""
    def cross(i: Column) -> Column:
        o, a, b = F.get(polygon, i), F.get(polygon, (i + 1) % 4), F.get(polygon, (i + 2) % 4)
        return (a[0] - o[0]) * (b[1] - a[1]) - (a[1] - o[1]) * (b[0] - a[0])
    return F.transform(F.sequence(F.lit(0), F.lit(3)), cross)


def is_convex(polygon: Column) -> Column:
    return let(turns(polygon), lambda t: (F.forall(t, lambda c: c > 1e-6)) | F.forall(t, lambda c: c < -1e-6))


def distortion(e: Column) -> Column:
    gap = lambda a, b: F.abs(e[a] - e[b]) / F.greatest(e[a], e[b])
    return F.greatest(gap(0, 2), gap(1, 3))


def text_height(polygon: Column) -> Column:
    """Shorter mean pair of opposite edges, so that rotation does not turn width into height; 0 when unusable."""
    return let(polygon, lambda p: let(edges(p), lambda e: F.when(
        is_convex(p) & (distortion(e) <= MAX_DISTORTION),
        F.least((e[0] + e[2]) / 2, (e[1] + e[3]) / 2)).otherwise(0.0)))


def legibility(measured: DataFrame) -> DataFrame:
    """``(doc_id, pos, height_px, scale_px_per_mm, minimum_mm, threshold_verified, coverage_ok)``.

    The status is always review; a verified threshold only adds how the height compares with it.
    """
    height = F.round(F.col("height_px") / F.col("scale_px_per_mm"), 4)
    bad_height, bad_scale = ~(F.coalesce(F.col("height_px"), F.lit(0.0)) > 0), ~(F.coalesce(F.col("scale_px_per_mm"), F.lit(0.0)) > 0)
    no_threshold = F.col("minimum_mm").isNull()
    plain = ~(bad_height | bad_scale | ~F.col("coverage_ok") | no_threshold)
    verified = plain & F.col("threshold_verified")
    return measured.select(
        "doc_id", "pos", F.lit("review_required").alias("status"),
        F.when(~bad_height & ~bad_scale, height).alias("height_mm"),
        F.when(bad_height, "height").when(bad_scale, "scale").when(~F.col("coverage_ok"), "coverage")
        .when(no_threshold, "no_threshold").otherwise("review").alias("reason"),
        F.when(verified, "verified_review_only").when(plain, "unverified").when(no_threshold & ~bad_height & ~bad_scale & F.col("coverage_ok"), "unavailable").alias("threshold_status"),
        F.when(verified, F.when(F.col("height_px") / F.col("scale_px_per_mm") >= F.col("minimum_mm"), "at_or_above").otherwise("below")).alias("comparison"))


def padded_box(box: Column, width: Column, height: Column, ratio: float) -> Column:
    pad_x, pad_y = ((box["x2"] - box["x1"]) * ratio).cast("int"), ((box["y2"] - box["y1"]) * ratio).cast("int")
    made = F.struct(F.greatest(F.lit(0), box["x1"] - pad_x).alias("x1"), F.greatest(F.lit(0), box["y1"] - pad_y).alias("y1"),
                    F.least(width, box["x2"] + pad_x).alias("x2"), F.least(height, box["y2"] + pad_y).alias("y2"))
    return let(made, lambda b: F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b))


def best_crop(boxes: DataFrame, padding: float = 0.05, min_area: float = 0.10) -> DataFrame:
    """Largest box of an image if it covers enough of the frame, padded and clamped."""
    area = (F.greatest(F.lit(0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0), F.col("y2") - F.col("y1"))).cast("long")
    best = boxes.withColumn("_area", area).groupBy("doc_id", "frame_w", "frame_h").agg(
        F.max("_area").alias("_area"),
        F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct("_area", -F.col("pos"))).alias("box"))
    kept = best.where(F.col("_area") >= F.col("frame_w") * F.col("frame_h") * min_area)
    return (kept.withColumn("crop", padded_box(F.col("box"), F.col("frame_w"), F.col("frame_h"), padding))
            .where("crop is not null").select("doc_id", "crop.*"))


def all_crops(boxes: DataFrame, padding: float = 0.05) -> DataFrame:
    crop = padded_box(F.struct("x1", "y1", "x2", "y2"), F.col("frame_w"), F.col("frame_h"), padding)
    return boxes.withColumn("crop", crop).where("crop is not null").select("doc_id", "pos", "crop.*")


# ---- physical scale -----------------------------------------------------------------------------

def scale_from_reference(observations: DataFrame, references: DataFrame) -> DataFrame:
    """Pixels per millimetre from observed reference axes, with propagated uncertainty.

    ``observations(obs_id, reference_id, axis, px, px_err)``, ``references(reference_id, axis, mm, uncertainty_mm)``.
    Every pair of axes must agree within the sum of their uncertainties, which is: no axis interval lies
    above another, so the largest lower end may not pass the smallest upper end.
    """
    wanted = observations.select("obs_id", "reference_id").distinct().join(references, "reference_id")
    seen = observations.withColumnRenamed("reference_id", "_ref").withColumnRenamed("axis", "_axis").withColumnRenamed("obs_id", "_obs")
    axes = wanted.join(seen, (F.col("obs_id") == F.col("_obs")) & (F.col("axis") == F.col("_axis")), "left")
    ok = (F.col("px") > 0) & (F.col("mm") > 0) & (F.col("px_err") >= 0) & (F.col("uncertainty_mm") >= 0)
    scale = F.when(ok, F.col("px") / F.col("mm"))
    spread = scale * F.sqrt(F.pow(F.col("px_err") / F.col("px"), 2) + F.pow(F.col("uncertainty_mm") / F.col("mm"), 2))
    agg = axes.withColumn("_s", scale).withColumn("_u", spread).groupBy("obs_id", "reference_id").agg(
        F.count("*").alias("n_axes"), F.count("_s").alias("n_ok"), F.avg("_s").alias("mean"),
        F.sqrt(F.sum(F.pow("_u", F.lit(2)))).alias("root"),
        F.max(F.col("_s") - F.col("_u")).alias("low"), F.min(F.col("_s") + F.col("_u")).alias("high"))
    missing, disagree = F.col("n_ok") < F.col("n_axes"), F.col("low") > F.col("high") + 1e-12
    good = ~missing & ~disagree
    return agg.select("obs_id", "reference_id",
                      F.when(missing, "REVIEW_REQUIRED").when(disagree, "REVIEW_REQUIRED").otherwise("CALIBRATED_REVIEW_ONLY").alias("status"),
                      F.when(missing, "axis_unavailable").when(disagree, "axes_disagree").alias("reason"),
                      F.when(good, F.round("mean", 8)).alias("scale_px_per_mm"),
                      F.when(good, F.round(F.col("root") / F.col("n_axes"), 8)).alias("uncertainty_px_per_mm"))


def scale_from_quad(quads: DataFrame) -> DataFrame:
    """``(code_id, polygon array<array<double>>, frame_w, frame_h, reference_mm)`` to pixels per millimetre."""
    poly = F.col("polygon")
    inside = F.forall(poly, lambda p: p[0].between(0, F.col("frame_w")) & p[1].between(0, F.col("frame_h")))
    staged = quads.withColumn("_e", edges(poly)).withColumn("_convex", is_convex(poly)).withColumn("_inside", inside)
    width = F.greatest((F.col("_e")[0] + F.col("_e")[2]) / 2, (F.col("_e")[1] + F.col("_e")[3]) / 2)
    reason = (F.when(~(F.coalesce(F.col("reference_mm"), F.lit(0.0)) > 0), "reference")
              .when(F.size(poly) != 4, "corners").when(~F.col("_inside"), "outside").when(~F.col("_convex"), "degenerate")
              .when(distortion(F.col("_e")) > MAX_DISTORTION, "distorted"))
    staged = staged.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return staged.select("code_id", F.when(good, "calibrated").otherwise("review_required").alias("status"), "reason",
                         F.when(good, F.round(width / F.col("reference_mm"), 6)).alias("scale_px_per_mm"),
                         F.when(good, F.round(distortion(F.col("_e")), 4)).alias("distortion"))


#: An image of more boxes than this is cut into tiles; below, cutting costs more than it spreads.
CROWDED = 256


def panel_coverage(boxes: DataFrame, tiles: int = 16, crowded: int = CROWDED) -> DataFrame:
    """Area of the union of axis-aligned boxes over the frame, per image.

    ``(doc_id, x1, y1, x2, y2, frame_w, frame_h)``. Boxes of an image with more than ``crowded`` of them are cut at
    vertical tile borders and the union is summed over tiles, so such an image is spread over tasks; equal pieces are
    merged before the shuffle. Within a tile the plane is cut into slabs at the distinct x edges, and a slab's covered
    length is an interval union.
    """
    image = ["doc_id", "frame_w", "frame_h"]
    many = boxes.groupBy(*image).agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).select(F.lit(True).alias("_many"), *[F.col(c).alias(f"_m_{c}") for c in image])
    cut = boxes.join(many, all_of([F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in image]), "left")
    tiles = F.when(F.col("_many"), tiles).otherwise(1)
    bad = ((F.col("x1") < 0) | (F.col("y1") < 0) | (F.col("x2") > F.col("frame_w")) | (F.col("y2") > F.col("frame_h"))
           | (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")))
    step = F.col("frame_w") / tiles
    tile_range = F.sequence(F.floor(F.greatest(F.col("x1"), F.lit(0)) / step).cast("int"),
                            F.floor(F.least(F.col("x2"), F.col("frame_w")) / step).cast("int"))
    pieces = (cut.withColumn("_bad", bad)
              .withColumn("_tile", F.explode(F.when(F.col("_bad"), F.array(F.lit(0))).otherwise(tile_range)))
              .select("doc_id", "frame_w", "frame_h", "_bad", "_tile",
                      F.greatest(F.col("x1").cast("double"), F.col("_tile") * step).alias("x1"),
                      F.least(F.col("x2").cast("double"), (F.col("_tile") + 1) * step).alias("x2"),
                      F.col("y1").cast("double").alias("y1"), F.col("y2").cast("double").alias("y2")))
    held = pieces.groupBy(*image, "_tile").agg(F.bool_or("_bad").alias("_bad"), F.collect_set(F.struct("y1", "y2", "x1", "x2")).alias("_boxes"))
    sides = F.array_union(F.transform("_boxes", lambda b: b["x1"]), F.transform("_boxes", lambda b: b["x2"]))
    per_tile = held.select(*image, "_bad", F.array_sort("_boxes").alias("_boxes"), F.array_sort(sides).alias("_edges"))

    def covered(crossing: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("length"), F.lit(float("-inf")).alias("reach"))
        return F.aggregate(crossing, start, lambda s, b: F.struct(
            (s["length"] + F.greatest(F.lit(0.0), b["y2"] - F.greatest(s["reach"], b["y1"]))).alias("length"),
            F.greatest(s["reach"], b["y2"]).alias("reach")))["length"]

    slabs = F.zip_with(F.slice("_edges", F.lit(1), F.size("_edges") - 1), F.slice("_edges", F.lit(2), F.size("_edges") - 1),
                       lambda a, b: (b - a) * covered(F.filter("_boxes", lambda x: (x["x1"] <= a) & (x["x2"] >= b))))
    area = per_tile.select(*image, "_bad",
                           F.aggregate(slabs, F.lit(0.0), lambda acc, v: acc + v).alias("_area"))
    total = area.groupBy(*image).agg(F.bool_or("_bad").alias("_bad"), F.sum("_area").alias("_area"))
    ratio = F.when(~F.col("_bad"), F.col("_area") / (F.col("frame_w") * F.col("frame_h")))
    return total.select("doc_id", F.round(ratio, 4).alias("coverage"),
                        F.when(ratio >= MIN_COVERAGE, "eligible").otherwise("review_required").alias("status"))


def reference_scale(measurements: DataFrame) -> DataFrame:
    """Height in mm of a feature next to a reference of known width; inputs that are not positive are rejected."""
    ok = (F.col("feature_px") > 0) & (F.col("reference_px") > 0) & (F.col("reference_mm") > 0)
    scale = F.col("reference_px") / F.col("reference_mm")
    drift = F.abs(F.col("observed_px") - F.col("reference_px")) / F.col("reference_px")
    return measurements.select(
        "code_id", F.when(ok, "measured").otherwise("rejected").alias("status"),
        F.when(ok, F.round(scale, 6)).alias("scale_px_per_mm"),
        F.when(ok, F.round(F.col("feature_px") / scale, 4)).alias("height_mm"),
        F.when(ok & (F.col("observed_px") > 0), F.round(drift, 4)).alias("distortion"),
        F.when(ok & (F.col("observed_px") > 0), drift <= MAX_DISTORTION).alias("acceptable"))
