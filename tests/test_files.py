"""Every reader and writer on real files."""

import hashlib
import json

from pyspark.sql import functions as F

from labelwright.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text) if isinstance(text, str) else path.write_bytes(text)


def test_ocr_lines_and_unreadable_ones(spark, tmp_path):
    good = {"doc_id": 1, "image_id": "i", "success": True, "detections": [{"text": " MRP 5 ", "confidence": None, "bbox": [1, 2, 3, 4]}, {"text": " "}, {"text": "x"}]}
    put(tmp_path / "a.json", json.dumps(good) + "\n\n{broken\n" + json.dumps({"doc_id": "seven"}) + "\n")
    docs = readers.read_ocr_docs(spark, str(tmp_path)).collect()
    assert len(docs) == 1 and docs[0].lines == ["MRP 5", "x"]
    d = docs[0].detections
    assert (d[0].confidence, d[0].x2, d[0].polygon) == (0.0, 3, [[1, 2], [3, 2], [3, 4], [1, 4]]) and (d[1].pos, d[1].x1, d[1].polygon) == (1, 0, [[0, 0]] * 4)
    bad = readers.unreadable_ocr(spark, str(tmp_path)).collect()
    assert sorted(r.record for r in bad) == ['{"doc_id": "seven"}', "{broken"] and all(r.file_path.endswith("a.json") for r in bad)
    assert readers.unreadable_ocr(spark, str(tmp_path)).count() == 2
    readers.read_ocr_docs(spark, str(tmp_path)).select("doc_id", "image_id", "success", F.transform("detections", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), F.lit(None).cast("array<int>").alias("bbox"),
        F.lit(None).cast("array<array<int>>").alias("polygon"))).alias("detections")).write.parquet(str(tmp_path / "p"))
    assert readers.read_ocr_docs(spark, str(tmp_path / "p"), "parquet").first().lines == ["MRP 5", "x"]


def test_file_inventory(spark, tmp_path):
    contents = {"a/x.JPG": b"\x00\x01", "a/y.txt": b"hello", "b/c/z.png": b"\x89", "b/big.webp": b"1" * (readers.MAX_IMAGE_BYTES + 1)}
    for name, content in contents.items():
        put(tmp_path / name, content)
    found = readers.read_file_inventory(spark, str(tmp_path))
    got = {r.path.split(f"{tmp_path.name}/")[1]: (r.size, r.sha256, r.ext_ok, r.size_ok) for r in found.collect()}
    assert got == {n: (len(c), hashlib.sha256(c).hexdigest(), not n.endswith("txt"), n != "b/big.webp") for n, c in contents.items()}
    assert readers.read_file_inventory(spark, str(tmp_path), "*.png").count() == 1
    plan = found.select("path", "size_ok")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "length" in plan  # sizes alone open no file


def test_rules(spark, tmp_path):
    rules = [{"id": "r1", "severity": "major", "check": '{"value_from": "lookup_tables.units"}'}, {"id": "r1", "severity": "odd"}, {"id": "r2", "severity": "major", "applies_when": "lookup_tables.gone"}]
    put(tmp_path / "r.json", json.dumps({"severities": ["major"], "rules": rules, "lookup_tables": {"units": "g"}}, indent=1))
    rows, lookups, violations = readers.read_rules(spark, str(tmp_path))
    assert rows.count() == 3 and [r.table for r in lookups.collect()] == ["units"]
    assert sorted(tuple(r) for r in violations.collect()) == [("r1", "duplicate_id"), ("r1", "undeclared_severity"), ("r2", "dangling_lookup")]


def test_corpus(spark, tmp_path):
    source = {"source_id": "s1", "title": "T", "citation": "C", "source_url": "https://a.example/x"}
    provision = {"provision_id": "p1", "source_id": "s1", "clause": "1", "text": "t", "effective_status": "original", "is_currently_effective": True}
    put(tmp_path / "c.json", json.dumps({"corpus_id": "c", "unresolved_fields": ["a", "b"], "blocked_fields": ["b"], "sources": [source, {**source, "source_id": "s2", "title": " ", "amends_source_id": "s9", "effective_from": "2024-02-30"}],
                                         "provisions": [provision, {**provision, "provision_id": "p2", "source_id": "s7", "effective_status": "superseded", "effective_from": "2025-01-01", "effective_until": "2024-01-01"}]}))
    sources, provisions, violations = readers.read_corpus(spark, str(tmp_path))
    assert sources.count() == 2 and provisions.count() == 2
    assert sorted(tuple(r) for r in violations.collect()) == [("b", "unresolved_and_blocked"), ("p2", "date_range"), ("p2", "superseded_but_effective"), ("p2", "unknown_source"), ("s2", "date_range"),
                                                              ("s2", "missing_field"), ("s2", "unknown_amended_source")]


def test_annotations_are_numbered_by_file(spark, tmp_path):
    put(tmp_path / "train/labels/a.txt", "0 0.5 0.5 0.2 0.2\n\n1 0.5 0.5\r\n7 0.5 0.5 0.1 0.1\nx 0 0 0 0")
    put(tmp_path / "val/labels/b.txt", "1 0.95 0.5 0.2 0.2\n1 1.5 0.5 0.2 0.2\n")
    put(tmp_path / "val/labels/empty.txt", "")
    rows = readers.read_annotations(spark, f"{tmp_path}/*/labels/*.txt", 2).collect()
    assert sorted((r.split, r.stem, r.line_no, r.error) for r in rows if r.error) == [("train", "a", 3, "tokens"), ("train", "a", 4, "class_out_of_range"), ("train", "a", 5, "class_not_integer"), ("val", "b", 1, "outside_frame"),
                                                                                    ("val", "b", 2, "coordinates")]
    assert [(r.stem, r.line_no, r.class_id, r.cx) for r in rows if not r.error] == [("a", 1, 0, 0.5)]


def test_provenance(spark, tmp_path):
    digest = "a" * 64
    fine = {"split": "train", "image": "a.jpg", "image_sha256": digest, "label_sha256": digest, "product_identity_sha256": digest, "source": "s", "license": "l", "category": "c", "operator": "o",
            "rights_confirmation": "operator_confirmed", "annotation_status": "positive", "object_count": 2}
    lines = [fine, {**fine, "split": "val", "image": "b.jpg"}, {**fine, "object_count": 0}, {**fine, "image": "c.jpg", "product_identity_sha256": "B" * 64, "license": " "}]
    put(tmp_path / "m.jsonl", "\n".join(map(json.dumps, lines)) + "\n{not json\n")
    rows, violations, conflicts = readers.read_provenance(spark, str(tmp_path))
    assert rows.count() == 5
    assert {(r.image, r.violations.split(",")[0]) for r in violations.collect()} == {("a.jpg", "count_disagrees"), ("c.jpg", "empty_value"), (None, "unreadable")}
    assert sorted(tuple(r) for r in conflicts.collect()) == [(digest, "product_in_several_splits"), ("train/a.jpg", "duplicate_image")]


def reports(spark, rows):
    return spark.createDataFrame(rows, "scan_id int, image_id int, created_at string, note string").withColumn("created_at", F.to_timestamp("created_at"))


def test_reports_are_appended_or_replaced_by_day(spark, tmp_path):
    path = str(tmp_path / "reports")
    sinks.write_reports(reports(spark, [(1, 1, "2024-01-01 10:00:00", "a"), (1, 2, "2024-01-02 10:00:00", "b")]), path)
    sinks.write_reports(reports(spark, [(2, 1, "2024-01-02 11:00:00", "c")]), path)
    back = spark.read.parquet(path)
    assert back.count() == 3 and back.where("day = date'2024-01-02'").count() == 2 and all(r.report_id.startswith("RPT-") and len(r.report_id) == 16 for r in back.collect())
    for _ in range(2):  # a repeated run replaces its own day
        sinks.replace_report_days(reports(spark, [(3, 1, "2024-01-02 12:00:00", "d")]), path)
    spark.catalog.refreshByPath(path)
    assert sorted(r.note for r in spark.read.parquet(path).collect()) == ["a", "d"]


def test_metrics_lines(spark, tmp_path):
    sinks.write_metrics_jsonl(spark.range(3), spark.createDataFrame([(3, 0.5)], "n int, mean double"), str(tmp_path))
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/records").collect()) == [0, 1, 2] and spark.read.json(f"{tmp_path}/summary").first().n == 3


def test_layouts_prune_and_join_without_shuffle(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 40).alias("product_id"), F.col("id").alias("version"), F.lit("x" * 20).alias("pad"))
    path = str(tmp_path / "laid")
    sinks.write_laid_out(rows, "product_revisions", path, 10)
    back = spark.read.parquet(path)
    assert back.count() == 4000 and back.where("product_id = 7").select(F.input_file_name()).distinct().count() <= 2
    by_file = {}
    for r in back.where("product_id = 7").select("version", F.input_file_name().alias("f")).collect():
        by_file.setdefault(r.f, []).append(r.version)
    assert sum(map(len, by_file.values())) == 100 and all(v == sorted(v, reverse=True) for v in by_file.values())
    try:
        for name in ("laid_a", "laid_b"):
            sinks.write_bucketed(rows, "product_revisions", name, str(tmp_path / name), 4)
        joined = spark.table("laid_a").join(spark.table("laid_b").hint("merge"), "product_id").groupBy("product_id").count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 40
    finally:
        for name in ("laid_a", "laid_b"):
            spark.sql(f"drop table if exists {name}")
