"""Readers with fixed schemas, and the table-level checks that go with them.

No reader infers a schema. Every check is a DataFrame of violations, so bad input is reported and not dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions.text import blank_to_null, group, strip
from labelwright.operators.lines import emit
from labelwright.operators.quality import referential_gaps

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
MAX_IMAGE_BYTES = 15 * 1024 * 1024

OCR_SCHEMA = ("doc_id bigint, image_id string, success boolean, detections array<struct<text:string,confidence:double,"
              "bbox:array<int>,polygon:array<array<int>>>>")
CORRUPT = "_corrupt_record"
RULES_SCHEMA = ("meta struct<title:string,schema_version:int>, severities array<string>, rules array<struct<id:string,severity:string,chapter:string,"
                "check:string,applies_when:string>>, lookup_tables map<string,string>")
CORPUS_SCHEMA = (
    "corpus_id string, schema_version int, unresolved_fields array<string>, blocked_fields array<string>, "
    "sources array<struct<source_id:string,title:string,citation:string,version:string,source_url:string,verification_status:string,"
    "amends_source_id:string,effective_from:string,effective_until:string>>, "
    "provisions array<struct<provision_id:string,source_id:string,clause:string,text:string,effective_status:string,is_currently_effective:boolean,"
    "effective_from:string,effective_until:string,supersedes_provision_id:string,linked_rule_id:string,linked_field:string>>")
TRUTH_SCHEMA = ("records array<struct<product_id:string,image_id:string,capture_conditions:array<string>,expected_fields:map<string,string>>>, "
                "product_id string, image_id string, capture_conditions array<string>, expected_fields map<string,string>")
PROVENANCE_SCHEMA = (
    "split string, image string, image_sha256 string, label_sha256 string, product_identity_sha256 string, source string, license string, "
    "category string, operator string, rights_confirmation string, annotation_status string, object_count int, conditions array<string>, _corrupt string")


# ---- recognised text ----------------------------------------------------------------------------

def read_ocr_docs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recognition results, one row per image, with detections in normal form; unreadable lines are left to
    ``unreadable_ocr``."""
    if fmt != "json":
        return normal_detections(spark.read.schema(OCR_SCHEMA).format(fmt).load(path))
    raw = _json_lines(spark, path, OCR_SCHEMA)
    return normal_detections(raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file_path"))


def unreadable_ocr(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, record`` of every line that does not fit the schema."""
    raw = _json_lines(spark, path, OCR_SCHEMA)
    return raw.where(F.col(CORRUPT).isNotNull()).select("file_path", F.col(CORRUPT).alias("record"))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with the file they come from; what cannot be read keeps its text in ``_corrupt_record``. Lines are
    parsed as an expression, so that no column can be pruned away from under the check."""
    lines = spark.read.text(path).where(F.length(strip(F.col("value"))) > 0).select("value", F.col("_metadata.file_path").alias("file_path"))
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("r"), "file_path").select("r.*", "file_path")


def normal_detections(raw: DataFrame) -> DataFrame:
    """Blank lines dropped, text stripped; a missing score is 0, a missing box zeros, a missing polygon the box corners."""
    box = lambda d: F.coalesce(d["bbox"], F.array(*[F.lit(0)] * 4))
    corners = lambda b: F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))
    kept = F.filter(F.coalesce("detections", F.expr("cast(array() as array<struct<text:string,confidence:double,bbox:array<int>,polygon:array<array<int>>>>)")),
                    lambda d: F.length(strip(F.coalesce(d["text"], F.lit("")))) > 0)
    made = F.transform(kept, lambda d, i: F.struct(
        i.alias("pos"), strip(d["text"]).alias("text"), F.coalesce(d["confidence"], F.lit(0.0)).alias("confidence"),
        box(d)[0].alias("x1"), box(d)[1].alias("y1"), box(d)[2].alias("x2"), box(d)[3].alias("y2"),
        F.coalesce(d["polygon"], corners(box(d))).alias("polygon")))
    return raw.withColumn("detections", made).withColumn("lines", F.transform("detections", lambda d: d["text"]))


def ocr_detections(docs: DataFrame) -> DataFrame:
    return emit(docs, F.col("detections"), "doc_id", "image_id")


# ---- files --------------------------------------------------------------------------------------

def read_file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and exact-bytes digest of files, with suffix and size checks. Spark's reader passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return inventory(files)


def inventory(files: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    # the reader knows a file's length without opening it: who asks for sizes only reads no content
    size = (F.col("length") if "length" in files.columns else F.length("content")).cast("bigint")
    return files.select("path", size.alias("size"), F.sha2("content", 256).alias("sha256"),
                        suffix.isin(*IMAGE_SUFFIXES).alias("ext_ok"), ((size > 0) & (size <= MAX_IMAGE_BYTES)).alias("size_ok"))


# ---- rules and corpus ---------------------------------------------------------------------------

def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules, lookup-table names and violations of a JSON ruleset."""
    raw = spark.read.schema(RULES_SCHEMA).option("multiLine", "true").json(path)
    rules = emit(raw, F.col("rules"), "severities")
    lookups = raw.select(F.explode(F.map_keys("lookup_tables")).alias("table"))
    return rules, lookups, rule_violations(rules, lookups)


def rule_violations(rules: DataFrame, lookups: DataFrame) -> DataFrame:
    """Duplicate ids, undeclared severities, references to lookup tables that do not exist."""
    repeated = rules.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit("duplicate_id").alias("violation"))
    severity = rules.where(~F.array_contains("severities", F.col("severity"))).select("id", F.lit("undeclared_severity").alias("violation"))
    text = F.concat_ws(" ", "check", "applies_when")
    wanted = rules.select("id", F.explode(F.regexp_extract_all(text, F.lit(r"lookup_tables\.(\w+)"), F.lit(1))).alias("table"))
    dangling = wanted.join(lookups, "table", "left_anti").select("id", F.lit("dangling_lookup").alias("violation"))
    return repeated.unionByName(severity).unionByName(dangling)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, provisions and violations of a JSON corpus."""
    raw = spark.read.schema(CORPUS_SCHEMA).option("multiLine", "true").json(path)
    sources, provisions = emit(raw, F.col("sources"), "corpus_id"), emit(raw, F.col("provisions"), "corpus_id")
    overlap = raw.withColumn("_o", F.array_intersect("unresolved_fields", "blocked_fields")).select(
        F.explode("_o").alias("id"), F.lit("unresolved_and_blocked").alias("violation"))
    return sources, provisions, corpus_violations(sources, provisions).unionByName(overlap)


def _reversed(df: DataFrame, key: str) -> DataFrame:
    start, end = F.try_to_date("effective_from"), F.try_to_date("effective_until")
    bad = (start > end) | (F.col("effective_from").isNotNull() & start.isNull()) | (F.col("effective_until").isNotNull() & end.isNull())
    return df.where(F.coalesce(bad, F.lit(False))).select(F.col(key).alias("id"), F.lit("date_range").alias("violation"))


def corpus_violations(sources: DataFrame, provisions: DataFrame) -> DataFrame:
    """Missing fields, duplicates, dangling references, date ranges, contradictory states, unsafe addresses."""
    blank = lambda c: blank_to_null(F.coalesce(F.col(c), F.lit(""))).isNull()
    note = lambda df, key, v: df.select(F.col(key).cast("string").alias("id"), F.lit(v).alias("violation"))
    missing_s = note(sources.where(blank("source_id") | blank("title") | blank("citation")), "source_id", "missing_field")
    missing_p = note(provisions.where(blank("provision_id") | blank("source_id") | blank("text") | blank("clause")), "provision_id", "missing_field")
    dup = lambda df, key: note(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), key, "duplicate_id")
    no_source = note(referential_gaps(provisions, sources, "source_id", "source_id"), "provision_id", "unknown_source")
    no_amended = note(referential_gaps(sources, sources, "amends_source_id", "source_id"), "source_id", "unknown_amended_source")
    no_superseded = note(referential_gaps(provisions, provisions, "supersedes_provision_id", "provision_id"), "provision_id", "unknown_superseded_provision")
    state = note(provisions.where(~F.coalesce("effective_status", F.lit("")).isin("original", "amended", "superseded")), "provision_id", "effective_status")
    both = note(provisions.where((F.col("effective_status") == "superseded") & F.col("is_currently_effective")), "provision_id", "superseded_but_effective")
    url = F.col("source_url")
    unsafe = note(sources.where(url.isNotNull() & ~url.rlike(r"(?i)^https://[^/@#?]+([/?][^#]*)?$")), "source_id", "unsafe_url")
    parts = [missing_s, missing_p, dup(sources, "source_id"), dup(provisions, "provision_id"), no_source, no_amended, no_superseded,
             _reversed(sources, "source_id"), _reversed(provisions, "provision_id"), state, both, unsafe]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- ground truth, annotations, provenance ------------------------------------------------------

def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Expected fields and violations; the file holds a list of records or an object with ``records``."""
    raw = spark.read.schema(TRUTH_SCHEMA).option("multiLine", "true").json(path)
    flat = F.struct("product_id", "image_id", "capture_conditions", "expected_fields")
    records = raw.select(F.explode(F.coalesce("records", F.array(flat))).alias("r")).select("r.*")
    return truth_rows(records), truth_violations(records)


def truth_rows(records: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("expected_fields"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("expected")))
    return emit(records, entries, "image_id")


def truth_violations(records: DataFrame) -> DataFrame:
    required = ("product_id", "image_id", "capture_conditions", "expected_fields")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    gaps = records.withColumn("_m", missing).where(F.size("_m") > 0).select("image_id", F.concat(F.lit("missing "), F.array_join("_m", ",")).alias("violation"))
    repeated = records.groupBy("image_id").agg(F.count("*").alias("_n")).where("_n > 1").select("image_id", F.lit("duplicate_image_id").alias("violation"))
    return gaps.unionByName(repeated)


def read_annotations(spark: SparkSession, path: str, n_classes: int) -> DataFrame:
    """Box annotation lines of text files under ``<split>/labels/<stem>.txt``, numbered within their file."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    split, stem = group(F.col("path"), r"([^/]+)/labels/[^/]+$"), group(F.col("path"), r"([^/]+)\.txt$")
    return annotations(annotation_lines(files.select(split.alias("split"), stem.alias("stem"), "text")), n_classes)


def annotation_lines(files: DataFrame) -> DataFrame:
    """``(split, stem, text)`` to ``(split, stem, line_no, value)``, counted from 1; blank lines count."""
    numbered = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("value")))
    return emit(files, numbered, "split", "stem")


def annotations(lines: DataFrame, n_classes: int) -> DataFrame:
    """``(split, stem, line_no, value)`` to class and box with an error code; blank lines are dropped."""
    t = F.split(strip(F.col("value")), r"\s+")
    number = lambda i: F.get(t, F.lit(i)).try_cast("double")
    cls = F.get(t, F.lit(0)).try_cast("int")
    coords = [number(i) for i in (1, 2, 3, 4)]
    in_range = coords[0].between(0, 1)
    for c in coords[1:]:
        in_range = in_range & c.between(0, 1)
    cx, cy, w, h = coords
    inside = (cx - w / 2 >= 0) & (cx + w / 2 <= 1) & (cy - h / 2 >= 0) & (cy + h / 2 <= 1) & (w > 0) & (h > 0)
    error = (F.when(F.size(t) != 5, "tokens").when(cls.isNull(), "class_not_integer").when((cls < 0) | (cls >= n_classes), "class_out_of_range")
             .when(~F.coalesce(in_range, F.lit(False)), "coordinates").when(~inside, "outside_frame"))
    return (lines.where(F.length(strip(F.col("value"))) > 0)
            .select("split", "stem", "line_no", cls.alias("class_id"), cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"), error.alias("error")))


def read_provenance(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, what is wrong with single ones, and what is wrong between them."""
    raw = _json_lines(spark, path, PROVENANCE_SCHEMA.removesuffix(", _corrupt string")).withColumnRenamed(CORRUPT, "_corrupt")
    return raw, provenance_violations(raw), provenance_conflicts(raw)


def provenance_conflicts(rows: DataFrame) -> DataFrame:
    """``id, violation``: an image recorded twice in a split, and a product that appears in several splits. Each is one
    aggregate with partial sums; a product's splits are at most the three allowed names and whatever else was written."""
    image = F.concat_ws("/", "split", "image")
    twice = rows.where(F.col("image").isNotNull()).groupBy(image.alias("id")).agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit("duplicate_image").alias("violation"))
    product = rows.where(F.col("product_identity_sha256").isNotNull()).groupBy(F.col("product_identity_sha256").alias("id"))
    several = product.agg(F.min("split").alias("_a"), F.max("split").alias("_z")).where("_a <> _z").select("id", F.lit("product_in_several_splits").alias("violation"))
    return twice.unionByName(several)


def provenance_violations(rows: DataFrame) -> DataFrame:
    """What is wrong with a provenance record: unreadable, empty values, counts, states, digests."""
    text = ["split", "image", "image_sha256", "label_sha256", "product_identity_sha256", "source", "license", "category", "operator",
            "rights_confirmation", "annotation_status"]
    empty = F.lit(False)
    for c in text:
        empty = empty | blank_to_null(F.coalesce(F.col(c), F.lit(""))).isNull()
    shape = F.lit(False)
    for c in ("image_sha256", "label_sha256", "product_identity_sha256"):
        shape = shape | ~F.coalesce(F.col(c), F.lit("")).rlike("^[0-9a-f]{64}$")
    n, status = F.col("object_count"), F.col("annotation_status")
    found = F.array_compact(F.array(
        F.when(F.col("_corrupt").isNotNull(), "unreadable"), F.when(empty, "empty_value"), F.when(n.isNull() | (n < 0), "object_count"),
        F.when(((status == "positive") & (n == 0)) | ((status == "negative") & (n != 0)), "count_disagrees"),
        F.when(~F.col("split").isin("train", "val", "test"), "split"),
        F.when((F.col("rights_confirmation") != "operator_confirmed") | ~status.isin("positive", "negative"), "rights_or_state"), F.when(shape, "digest")))
    return rows.withColumn("_v", found).where(F.size("_v") > 0).select("split", "image", F.array_join("_v", ",").alias("violations"))
