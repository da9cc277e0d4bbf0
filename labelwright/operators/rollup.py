"""Field checks, status roll-ups and dashboards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import measures as M
from labelwright.functions import patterns as P
from labelwright.functions.text import first_where, has, let, strip
from labelwright.operators.lines import emit, is_heading_only

# Which statuses confirm, refute or leave open.
CONFIRMED = ("PASS", "COMPLIANT")
REFUTED = ("FAIL", "PARTIAL", "NON_COMPLIANT")
OPEN = ("NEEDS_MANUAL_VERIFICATION", "REVIEW_REQUIRED")
UNIT_PRICE_EQUALS_PRICE = 1000.0
RULE_STATUSES = ("PASS", "FAIL", "REVIEW_REQUIRED", "NOT_APPLICABLE", "NOT_ASSESSED")
PANEL_ALIASES = {"front panel": "front", "front-side": "front", "front side": "front", "back panel": "back",
                 "back-side": "back", "back side": "back", "product label": "label", "front label": "label", "label panel": "label"}


def rollup_checks(checks: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """Status and score of a set of checks. The score counts confirmed checks only and is NULL without any;
    a confirmed failure outranks uncertainty, which outranks success."""
    s = F.col(status)
    agg = checks.groupBy(*key).agg(F.count_if(s.isin(*CONFIRMED)).alias("compliant"),
                                   F.count_if(s.isin(*REFUTED)).alias("non_compliant"), F.count_if(s.isin(*OPEN)).alias("low_confidence"),
                                   F.count_if(s != "NOT_APPLICABLE").alias("_applicable"))
    overall = (F.when(F.col("_applicable") == 0, "NOT_APPLICABLE").when(F.col("non_compliant") > 0, "NON_COMPLIANT")
               .when(F.col("low_confidence") > 0, "REVIEW_REQUIRED").otherwise("COMPLIANT"))
    score = F.round(F.try_divide(F.col("compliant") * 100, F.col("compliant") + F.col("non_compliant")), 2)
    return agg.withColumn("status", overall).withColumn("score", score).drop("_applicable")


def overall_status(rules: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    s = F.col(status)
    out = (F.when(F.bool_or(s == "FAIL"), "NON_COMPLIANT").when(F.bool_or(s.isin("REVIEW_REQUIRED", "NOT_ASSESSED")), "REVIEW_REQUIRED")
           .when(F.bool_and(s == "NOT_APPLICABLE"), "NOT_APPLICABLE").otherwise("PASS"))
    return rules.groupBy(*key).agg(out.alias("overall_status"))


def status_counts(rules: DataFrame, key: list[str]) -> DataFrame:
    s = F.col("status")
    return rules.groupBy(*key).agg(*[F.count_if(s == v).alias(v.lower()) for v in RULE_STATUSES], F.count("*").alias("total"),
                                   F.count_if("has_check").alias("with_check"), F.count_if(~F.col("has_check")).alias("without_check"))


def field_checks(fields: DataFrame, reference_year: int, reference_month: int, profile: list[str] | None = None,
                 threshold: float = P.FIELD_CONFIDENCE) -> DataFrame:
    """Status of every required field from the long field table.

    The unit price also looks at the net quantity, so fields are brought together per document with one
    aggregate of at most one struct per field name, and checked in one projection.
    """
    required = profile or P.RETAIL_FIELDS
    row = F.struct("value", "detected", "confidence", "care_name", "care_address", "care_telephone_number", "care_email_address")
    wide = fields.groupBy("doc_id").agg(*[F.first(F.when(F.col("field") == f, row), ignorenulls=True).alias(f)
                                          for f in dict.fromkeys([*required, "net_quantity"])])
    return emit(wide, check_array(F.col, required, reference_year, reference_month, threshold))


def check_documents(docs: DataFrame, reference_year: int, reference_month: int, profile: list[str] | None = None,
                    threshold: float = P.FIELD_CONFIDENCE) -> DataFrame:
    """Adds ``checks`` to documents that carry their ``fields`` in an array: the same checks without any shuffle."""
    held = lambda name: first_where(F.col("fields"), lambda f: f["field"] == name)
    return docs.withColumn("checks", check_array(held, profile or P.RETAIL_FIELDS, reference_year, reference_month, threshold))


def check_array(field: Callable[[str], Column], required: list[str], reference_year: int, reference_month: int, threshold: float) -> Column:
    """(field, status) structs of the required fields; ``field`` gives the struct of a field by name."""
    review = F.lit("NEEDS_MANUAL_VERIFICATION")

    def seen(f: Column) -> Column:
        return F.coalesce(f["detected"], F.lit(False))

    def sure(f: Column) -> Column:
        return seen(f) & (f["confidence"] >= threshold)

    def price(f: Column) -> Column:
        v = f["value"]
        good = (F.size(M.amounts(v)) == 1) & has(v, P.PRICE_LABEL) & has(v, P.TAX_WORDING)
        return F.when(sure(f) & F.coalesce(good, F.lit(False)), "PASS").otherwise(review)

    def unit_price(f: Column) -> Column:
        amount = M.unit_price_amount(f["value"])
        exempt = let(field("net_quantity"), lambda q: seen(q) & (F.abs(M.quantity_amount(q["value"]) - UNIT_PRICE_EQUALS_PRICE) < 0.01))
        return (F.when(seen(f), F.when(amount.isNotNull() & (f["confidence"] >= threshold), "PASS").otherwise(review))
                .when(F.coalesce(exempt, F.lit(False)), "PASS").otherwise(review))

    def care(f: Column) -> Column:
        complete = F.lit(True)
        for part in ("care_name", "care_address", "care_telephone_number", "care_email_address"):
            complete = complete & (F.length(F.coalesce(f[part], F.lit(""))) > 0)
        return F.when(~seen(f), review).when(complete, "PASS").otherwise("PARTIAL")

    def check(name: str, f: Column) -> Column:
        if name == "maximum_retail_price_mrp":
            return price(f)
        if name == "unit_sale_price":
            return unit_price(f)
        if name == "net_quantity":
            return F.when(sure(f) & M.quantity_amount(f["value"]).isNotNull(), "PASS").otherwise(review)
        if name in ("manufacturer_packer_importer_details", "name_and_address_of_manufacturer_or_packer"):
            return F.when(sure(f) & ~F.coalesce(is_heading_only(f["value"]), F.lit(False)), "PASS").otherwise(review)
        if name == "consumer_care_details":
            return care(f)
        if name == "month_and_year_of_manufacture_or_packing":
            future = F.coalesce(M.year_month(f["value"]) > reference_year * 100 + reference_month, F.lit(False))
            return F.when(sure(f) & ~future, "PASS").otherwise(review)
        return F.when(sure(f), "PASS").otherwise(review)

    def named(n: str) -> Column:
        return let(field(n), lambda f: F.struct(F.lit(n).alias("field"), check(n, f).alias("status")))

    return F.array(*[named(n) for n in required])


def rollup_in_row(docs: DataFrame, checks: str = "checks") -> DataFrame:
    """``rollup_checks`` for documents that carry their checks in an array: a projection."""
    count = lambda names: F.size(F.filter(checks, lambda c: c["status"].isin(*names))).cast("bigint")
    staged = (docs.withColumn("compliant", count(CONFIRMED)).withColumn("non_compliant", count(REFUTED)).withColumn("low_confidence", count(OPEN)))
    applicable = F.exists(checks, lambda c: c["status"] != "NOT_APPLICABLE")
    status = (F.when(~applicable, "NOT_APPLICABLE").when(F.col("non_compliant") > 0, "NON_COMPLIANT")
              .when(F.col("low_confidence") > 0, "REVIEW_REQUIRED").otherwise("COMPLIANT"))
    score = F.round(F.try_divide(F.col("compliant") * 100, F.col("compliant") + F.col("non_compliant")), 2)
    return staged.withColumn("status", status).withColumn("score", score)


def summary(checks: DataFrame) -> DataFrame:
    """Counters of a document and its missing fields; at most one entry per required field."""
    s = F.col("status")
    short = F.array_sort(F.collect_set(F.when(s.isin("FAIL", "PARTIAL"), F.col("field"))))
    return checks.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(s == "PASS").alias("passed"), F.count_if(s == "FAIL").alias("failed"),
        F.count_if(s == "PARTIAL").alias("partial"), F.count_if(s.isin(*OPEN)).alias("manual_verification"),
        F.count_if(s == "NOT_APPLICABLE").alias("not_applicable"), F.array_join(short, ",").alias("missing_fields")
    ).withColumn("warning", F.when(F.col("manual_verification") > 0, F.concat(
        F.col("manual_verification").cast("string"), F.lit(" check(s) could not be verified"))))


def official_dashboard(scans: DataFrame, cases: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Per owner: scans, open / escalated / closed cases, compliance rate over scored scans (0 without any)."""
    per_scan = scans.groupBy(key).agg(
        F.count("*").alias("total_scans"), F.count("score").alias("_scored"),
        F.count_if((F.col("status") == "compliant") & F.col("score").isNotNull()).alias("_good"),
        F.count_if(F.to_date("date") == as_of).alias("scans_today"))
    per_case = cases.groupBy(key).agg(
        F.count_if(F.col("case_status").isin("open", "under_review", "escalated")).alias("open_violations"),
        F.count_if(F.col("case_status") == "escalated").alias("escalated"), F.count_if(F.col("case_status") == "closed").alias("closed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rate = F.coalesce(F.round(F.try_divide(F.col("_good") * 100, F.col("_scored"))), F.lit(0.0)).cast("bigint")
    return per_scan.join(per_case, key, "full_outer").select(
        key, zero("total_scans"), zero("scans_today"), zero("open_violations"), zero("escalated"), zero("closed"), rate.alias("compliance_rate"))


def manufacturer_dashboard(products: DataFrame, key: str) -> DataFrame:
    good = F.count_if(F.col("status") == "compliant")
    return products.groupBy(key).agg(
        F.count("*").alias("total_products"), good.alias("compliant_products"), (F.count("*") - good).alias("needs_fixes"),
        F.coalesce(F.round(F.avg("score")), F.lit(0.0)).cast("bigint").alias("compliance_score"))


def capture_completeness(panels: DataFrame, required: tuple[str, ...] = ("front", "back", "label")) -> DataFrame:
    """Required panels an item still lacks; only required names enter the set, so it stays small."""
    key = F.lower(strip(F.coalesce("panel", F.lit(""))))
    mapping = F.create_map(*[F.lit(x) for kv in PANEL_ALIASES.items() for x in kv])
    named = panels.withColumn("_p", F.coalesce(F.try_element_at(mapping, key), key))
    held = named.groupBy("doc_id").agg(*[F.bool_or(F.col("_p") == r).alias(f"_{r}") for r in required])
    missing = F.array_compact(F.array(*[F.when(~F.col(f"_{r}"), F.lit(r)) for r in required]))
    return held.select("doc_id", F.array_join(missing, ",").alias("missing_panels"), (F.size(missing) == 0).alias("complete"))
