"""Calculations on packages, instruments and inspected lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.sizing import broadcast_if_small
from labelwright.operators.lookups import band_lookup

TARE_SINGLE_FACTOR = 0.3


def panel_area(packages: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Display-panel area in cm²: an explicit area, else by shape; ``factors`` gives the share per shape."""
    length = lambda name: F.coalesce(F.col(f"{name}_cm"), F.col(f"{name}_mm") / 10)
    shape = F.col("shape")
    area = (F.when(F.col("area_cm2").isNotNull(), F.col("area_cm2"))
            .when(shape == "rectangular", length("height") * length("width") * factors["rectangular"])
            .when(shape == "cylindrical", length("height") * length("circumference") * factors["cylindrical"])
            .when(shape == "other", F.coalesce("considered_cm2", "surface_cm2") * factors["other"]))
    return packages.select("doc_id", area.alias("panel_area_cm2"), F.when(area.isNull(), "NOT_ASSESSED").otherwise("CALCULATED").alias("status"))


def max_permissible_error(packages: DataFrame, bands: DataFrame, quantity: str = "declared") -> DataFrame:
    """Absolute error of the band, or its percentage: to 0.1 half-up up to 1000, to the next whole above."""
    banded = band_lookup(packages, bands, quantity)
    raw = F.col(quantity).cast("decimal(18,6)") * F.col("percent").cast("decimal(9,4)") / 100
    rounded = F.when(F.col(quantity) <= 1000, F.round(raw, 1).cast("double")).otherwise(F.ceil(raw).cast("double"))
    mpe = F.when(F.col(quantity) > 0, F.coalesce(F.col("absolute").cast("double"), rounded))
    return banded.withColumn("mpe", mpe).drop("low", "high", "absolute", "percent")


def package_deficiency(packages: DataFrame) -> DataFrame:
    """Shortfall of an actual quantity against the declared one and the permissible error."""
    known = F.col("declared").isNotNull() & F.col("actual").isNotNull() & F.col("mpe").isNotNull()
    error = F.when(known, F.greatest(F.lit(0.0), F.col("declared") - F.col("actual")))
    return (packages.withColumn("error", error).withColumn("status", F.when(known, "CALCULATED").otherwise("NOT_ASSESSED"))
            .withColumn("exceeds_mpe", F.col("error") > F.col("mpe")).withColumn("exceeds_twice_mpe", F.col("error") > 2 * F.col("mpe")))


def lot_approval(lots: DataFrame, samples: DataFrame, plan: DataFrame, bands: DataFrame) -> DataFrame:
    """Decision per lot from exactly the planned number of samples.

    ``lots(lot_id, lot_size, declared)``, ``samples(lot_id, quantity, declarations_present)``,
    ``plan(low, high, sample_size, correction, allowed)``. The samples are aggregated with partial sums; an error
    of exactly twice the permissible error counts neither as between nor as over.
    """
    planned = max_permissible_error(band_lookup(lots, plan, "lot_size", low_open=False).drop("low", "high"), bands)
    error = F.greatest(F.lit(0.0), F.col("declared") - F.col("quantity"))
    mpe = F.col("mpe")
    stats = samples.join(planned.select("lot_id", "declared", "mpe"), "lot_id").groupBy("lot_id").agg(
        F.count("*").alias("n"), F.count("quantity").alias("n_quantity"), F.avg("quantity").alias("mean"),
        F.coalesce(F.stddev_samp("quantity"), F.lit(0.0)).alias("deviation"),
        F.count_if((error > mpe) & (error < 2 * mpe)).alias("between"), F.coalesce(F.bool_or(error > 2 * mpe), F.lit(False)).alias("over"),
        F.count("declarations_present").alias("n_flags"), F.bool_and("declarations_present").alias("all_present"))
    joined = planned.join(stats, "lot_id", "left")
    assessed = (F.col("sample_size").isNotNull() & (F.col("n") == F.col("sample_size")) & F.col("declared").isNotNull() & mpe.isNotNull()
                & (F.col("n_quantity") == F.col("n")) & (F.col("n_flags") == F.col("n")))
    corrected = F.col("mean") + F.col("deviation") * F.col("correction")
    passed = (corrected >= F.col("declared")) & (F.col("between") <= F.col("allowed")) & ~F.col("over") & F.col("all_present")
    assessed = F.coalesce(assessed, F.lit(False))
    return joined.select("lot_id", "lot_size", "sample_size", F.coalesce("n", F.lit(0)).alias("samples"),
                         F.when(~assessed, "NOT_ASSESSED").when(passed, "PASS").otherwise("FAIL").alias("status"),
                         F.when(assessed, F.col("mean")).alias("mean"), F.when(assessed, F.col("deviation")).alias("deviation"),
                         F.when(assessed, corrected).alias("corrected_average"))


def tare_procedure(lots: DataFrame, tares: DataFrame, required: int = 5, spread_factor: float = 0.2) -> DataFrame:
    """Which tare applies to a lot: a single light tare, the mean of the first tares, or individual weighing.

    ``lots(lot_id, basis, mpe, single_tare, gravity_constant)``, ``tares(lot_id, pos, tare)`` with positions from 0,
    so that the first n tares are a filter.
    """
    first = tares.where(F.col("pos") < required).groupBy("lot_id").agg(
        F.count("*").alias("n"), F.count("tare").alias("n_ok"), (F.max("tare") - F.min("tare")).alias("spread"), F.avg("tare").alias("mean_tare"))
    j = lots.join(first, "lot_id", "left")
    mpe = F.col("mpe")
    liquid = F.col("basis") == "volume"
    procedure = (F.when(mpe.isNull(), "not_assessed").when(liquid & F.col("gravity_constant").isNull(), "not_assessed")
                 .when(liquid & ~F.col("gravity_constant"), "measure_by_volume")
                 .when(F.col("single_tare") <= mpe * TARE_SINGLE_FACTOR, "single_tare")
                 .when(F.coalesce(F.col("n"), F.lit(0)) < required, "not_assessed").when(F.col("n_ok") < required, "not_assessed")
                 .when(F.col("spread") <= mpe * spread_factor, "mean_tare").otherwise("individual_tare"))
    staged = j.withColumn("procedure", procedure)
    status = (F.when(F.col("procedure").isin("single_tare", "mean_tare"), "CALCULATED")
              .when(F.col("procedure") == "individual_tare", "REVIEW_REQUIRED").otherwise("NOT_ASSESSED"))
    tare = F.when(F.col("procedure") == "single_tare", F.col("single_tare")).when(F.col("procedure") == "mean_tare", F.col("mean_tare"))
    return staged.select("lot_id", "procedure", status.alias("status"), tare.alias("tare"))


def net_weight_rule(df: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Net quantity against package less wrapper."""
    known = F.col("total").isNotNull() & F.col("wrapper").isNotNull() & F.col("net").isNotNull()
    equal = F.abs(F.col("net") - (F.col("total") - F.col("wrapper"))) < tolerance
    return df.withColumn("status", F.when(~known, "NEEDS_MANUAL_VERIFICATION").when(equal, "COMPLIANT").otherwise("NON_COMPLIANT"))


def verification_interval(df: DataFrame, as_of: Column) -> DataFrame:
    """Expiry of an instrument: 24 months for capacity, length and weight measures, else 12; the day is clamped."""
    kind = F.lower(F.coalesce("instrument_category", F.lit("")))
    months = F.when(kind.rlike("capacity|length|weight"), 24).otherwise(12)
    expiry = F.add_months("last_verified", months)
    return df.withColumn("expires", expiry).withColumn("status", F.when(F.col("last_verified").isNull(), "NEEDS_MANUAL_VERIFICATION")
                                                       .when(F.col("expires") >= as_of, "COMPLIANT").otherwise("NON_COMPLIANT"))


def outcome_profile(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))
