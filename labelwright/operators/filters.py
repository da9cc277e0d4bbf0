"""Selections and row classifications over scans, revisions, detections and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.addresses import is_internal, v4_digits, v6_digits
from labelwright.functions.geometry_checks import finite
from labelwright.functions.text import all_of, lookup, strip

# List buckets, profiles and reference geometry.
LIST_STATUS = {"PASS": "compliant", "COMPLIANT": "compliant", "NON_COMPLIANT": "flagged", "PARTIALLY_COMPLIANT": "partial",
               "NEEDS_MANUAL_VERIFICATION": "manual_review", "REVIEW_REQUIRED": "manual_review", "NOT_APPLICABLE": "not_applicable"}
OPEN_STATUSES = ("PENDING_OFFICIAL_REVIEW", "UNDER_OFFICIAL_REVIEW")
INSTRUMENT_CATEGORIES = ("weighing_instrument", "instrument", "pos hardware")
WHOLESALE_CATEGORIES = ("wholesale", "wholesale_package", "wholesale package")
UNSUPPORTED_PRODUCTS = ("unknown", "unrelated", "other")
GEOMETRY_AXES = {"rectangle": ["height", "width"], "circle": ["diameter"], "aruco_square": ["side"]}


def public_view(df: DataFrame, internal: list[str], ids: list[str], image_col: str | None = None,
                url_format: str = "/revisions/%s/image", key: str = "revision_id", decisions: str | None = None) -> DataFrame:
    """Drop internal columns, stringify ids, add the image URL where an image exists, redact ids inside decisions."""
    out = df
    for c in ids:
        out = out.withColumn(c, F.col(c).cast("string"))
    if image_col:
        out = out.withColumn("image_url", F.when(F.col(image_col).isNotNull(), F.format_string(url_format, F.col(key).cast("string"))))
    if decisions:
        out = out.withColumn(decisions, F.transform(decisions, lambda d: d.withField("official_id", d["official_id"].cast("string"))))
    return out.drop(*internal)


def owned_by(df: DataFrame, owner, owner_col: str = "user_id") -> DataFrame:
    return df.where(F.col(owner_col) == F.lit(owner))


def submitted(df: DataFrame, status: str = "review_status") -> DataFrame:
    return df.where(F.col(status).isNotNull())


def in_queue(df: DataFrame, wanted: str = "open", status: str = "review_status") -> DataFrame:
    return df.where(F.col(status).isin(*OPEN_STATUSES) if wanted == "open" else F.col(status) == wanted)


def search(df: DataFrame, columns: list[str], text: str = "", **equal) -> DataFrame:
    """Case-insensitive substring over the joined columns, plus equality filters."""
    conditions = [F.lower(F.concat_ws(" ", *columns)).contains(text.lower())] if text else []
    conditions += [F.col(c) == v for c, v in equal.items() if v is not None]
    return df.where(all_of(conditions)) if conditions else df


def map_status(df: DataFrame, status: str = "status", out: str = "bucket") -> DataFrame:
    return df.withColumn(out, F.coalesce(lookup(LIST_STATUS, F.col(status)), F.lit("manual_review")))


def select_profile(df: DataFrame, category: str = "category") -> DataFrame:
    key = F.lower(strip(F.col(category)))
    profile = (F.when(key.isin(*INSTRUMENT_CATEGORIES), "pos_hardware_audit")
               .when(key.isin(*WHOLESALE_CATEGORIES), "wholesale_package").otherwise("e_commerce_product_listing"))
    return df.withColumn("profile", profile).withColumn("is_wholesale", F.coalesce(key.isin(*WHOLESALE_CATEGORIES), F.lit(False)))


def clean_detections(df: DataFrame, cap: int | None = None, text_chars: int | None = None) -> DataFrame:
    """Finite boxes with an area; confidence clamped, text trimmed. ``cap`` keeps the first boxes of an image by ``pos``
    and ``text_chars`` the beginning of a text; without them nothing is cut."""
    box = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    conf = F.col("confidence").cast("double")
    ok = all_of([finite(c) for c in [*box, conf]]) & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    text = strip(F.coalesce("text", F.lit("")))
    return (df.where(ok if cap is None else ok & (F.col("pos") < cap))
            .withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)))
            .withColumn("text", text if text_chars is None else F.substring(text, 1, text_chars)))


def reports_or_scan(scans: DataFrame, reports: DataFrame, override: tuple[str, ...] = ("status", "score")) -> DataFrame:
    """One row per report, else the scan itself; report columns override scan columns.

    Reports are a table of their own, so a scan with very many reports is joined and never gathered.
    """
    r = reports.select(F.col("scan_id").alias("_s"), "report_id", *[F.col(c).alias(f"_{c}") for c in override])
    return (scans.join(r, F.col("scan_id") == F.col("_s"), "left")
            .select("scan_id", "report_id", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in override]))


def quality_gate(df: DataFrame, minimum: float = 0.80, confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    return df.withColumn("gate", F.when(c.isNull(), "missing").when(c < minimum, "low_confidence").otherwise("ok"))


def text_visibility(docs: DataFrame, detections: DataFrame) -> DataFrame:
    """Per document, whether text regions were found; ``docs(doc_id, success)``."""
    counts = detections.groupBy("doc_id").agg(F.count("*").alias("_n"))
    n = F.when(F.col("success"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("bigint")
    status = (F.when(~F.col("success"), "unavailable").when(n > 0, "regions_detected").otherwise("not_detected_review_required"))
    return docs.join(counts, "doc_id", "left").select("doc_id", status.alias("status"), n.alias("region_count"))


def profile_applicability(df: DataFrame) -> DataFrame:
    """``(doc_id, rule_id, product_type, package_type)`` to applicable or not, before evaluation."""
    off = F.col("product_type").isin(*UNSUPPORTED_PRODUCTS) | (
        (F.col("rule_id") == "wholesale_declarations") & (F.col("package_type") != "wholesale"))
    return df.withColumn("applicability", F.when(off, "NOT_APPLICABLE").otherwise("APPLICABLE"))


def enforce_registration(refs: DataFrame, as_of: Column) -> DataFrame:
    """Registry constraints by reference type, with the status and calibration eligibility that follow.

    ``refs(reference_id, reference_type, geometry_kind, nominal, measured, uncertainty: map<string,double>,
    provenance_ok, source_verified, marker_id, valid_until)``.
    """
    axes = lambda c: F.array_sort(F.map_keys(F.col(c)))
    expected = F.try_element_at(F.create_map(*[x for k, v in GEOMETRY_AXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]),
                                F.col("geometry_kind"))
    positive = lambda c: F.forall(F.map_values(F.col(c)), lambda v: finite(v) & (v > 0))
    kind = F.col("reference_type")
    used = F.when(F.size("measured") > 0, axes("measured")).otherwise(axes("nominal"))
    standard, verified = kind == "STANDARD_REFERENCE", kind == "VERIFIED_REFERENCE"
    checks = [
        (~kind.isin("STANDARD_REFERENCE", "VERIFIED_REFERENCE", "USER_ASSERTED_REFERENCE"), "type"),
        (~(positive("nominal") & positive("measured") & positive("uncertainty")), "dimension_value"),
        (standard & ((F.size("nominal") == 0) | ~F.col("provenance_ok")), "provenance"),
        (standard & ~F.col("source_verified"), "source_unconfirmed"),
        (standard & (axes("nominal") != expected), "axes"),
        (standard & (axes("nominal") != axes("uncertainty")), "uncertainty_axes"),
        (verified & ((F.size("measured") == 0) | (F.size("uncertainty") == 0) | ~F.col("provenance_ok")), "provenance"),
        (verified & (axes("measured") != axes("uncertainty")), "uncertainty_axes"),
        ((F.size(used) > 0) & (used != expected), "axes"),
        ((F.col("geometry_kind") == "aruco_square") & F.col("marker_id").isNull(), "marker"),
    ]
    violations = F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])))
    status = F.when(F.col("valid_until") < as_of, "EXPIRED").when(verified, "VERIFIED").otherwise("REGISTERED")
    staged = refs.withColumn("violations", violations).withColumn("status", F.when(F.size("violations") == 0, status))
    eligible = (F.size("violations") == 0) & (F.col("status") != "EXPIRED") & (standard | verified) & (F.size(used) > 0)
    return staged.withColumn("eligible", eligible)


def url_class(url: Column) -> Column:
    """Literal checks of a URL: scheme, credentials, port, localhost, and IPv4 or IPv6 addresses that are not public."""
    text = strip(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:\[]*)(.*)$", 1)
    bracketed = host.startswith("[")
    digits = F.when(bracketed, v6_digits(F.regexp_extract(host, r"^\[(.*)\]$", 1))).otherwise(v4_digits(host))
    port_fits = port.rlike(r"^(?::\d*)?$") & (F.coalesce(F.ltrim(F.substring(port, 2, 1000), F.lit("0")).try_cast("decimal(38,0)"), F.lit(0)) <= 65535) & (F.length(port) < 30)
    return (F.when(F.length(F.coalesce(text, F.lit(""))) == 0, "invalid_url")
            .when(~scheme.isin("http", "https"), "unsupported_scheme")
            .when(authority.contains("@") , "invalid_url").when(F.length(host) == 0, "invalid_url")
            .when(bracketed & digits.isNull(), "invalid_url")
            .when(host.isin("localhost", "localhost.localdomain") | host.endswith(".localhost"), "ssrf_blocked")
            .when(~port_fits, "invalid_url")
            .when(F.coalesce(is_internal(digits), F.lit(False)), "ssrf_blocked").otherwise("public"))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(strip(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1))


def url_audit(urls: DataFrame, col: str = "url") -> DataFrame:
    """Share of URLs per host and class."""
    classed = urls.select(url_host(F.col(col)).alias("host"), url_class(F.col(col)).alias("url_class"))
    per_class = classed.groupBy("host", "url_class").agg(F.count("*").alias("n"))
    per_host = per_class.groupBy("host").agg(F.sum("n").alias("total"))
    return per_class.join(per_host, "host").select("host", "url_class", "n", (F.col("n") / F.col("total")).alias("share"))
