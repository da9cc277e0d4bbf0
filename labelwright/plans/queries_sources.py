"""Queries of sources and sinks, reading the given tables in the shape of their inputs (survey S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.operators import lines as L
from labelwright.sources import readers as S
from labelwright.sources import sinks
from labelwright.plans.registry import query


@query("s1_ocr_documents", """select doc_id, pos, text, confidence, case when doc_id % 4 = 0 then 0 else 40 end as x1, case when doc_id % 4 = 0 then 0 else 30 * pos0 end as y1 from (
 select doc_id, n as pos, n as pos0, trim(text) as text, case when n % 5 = 0 then 0.0 else (60 + (doc_id * 7 + n * 13) % 40) / 100.0::double end as confidence from label_lines)""", ("label_lines",))
def _(t):
    k = F.col("doc_id")
    detection = lambda d: F.struct(F.concat(F.lit(" "), d["text"], F.lit("\t")).alias("text"), F.when(d["pos"] % 5 != 0, d["confidence"]).alias("confidence"),
                                   F.when(k % 4 != 0, F.array(d["x1"], d["y1"], d["x2"], d["y2"])).alias("bbox"), F.lit(None).cast("array<array<int>>").alias("polygon"))
    blank = F.array(F.struct(F.lit("  ").alias("text"), F.lit(0.5).alias("confidence"), F.lit(None).cast("array<int>").alias("bbox"), F.lit(None).cast("array<array<int>>").alias("polygon")))
    raw = t.label_docs.select("doc_id", F.lit("i0").alias("image_id"), F.lit(True).alias("success"), F.concat(F.transform("detections", detection), blank).alias("detections"))
    return S.ocr_detections(S.normal_detections(raw)).select("doc_id", "pos", "text", "confidence", "x1", "y1")


@query("s2_file_inventory", "select page_id as id, strlen(html)::bigint as size, sha256(html) as sha256, page_id % 3 <> 0 as ext_ok, true as size_ok from pages")
def _(t):
    k = F.col("page_id")
    files = t.pages.select(F.concat(F.lit("/data/"), k.cast("string"), F.when(k % 3 == 0, ".html").otherwise(".JPG")).alias("path"), F.encode("html", "utf-8").alias("content"))
    return S.inventory(files).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("bigint").alias("id"), "size", "sha256", "ext_ok", "size_ok")


@query("s3_rule_violations", """with r as (select 'r' || s_suppkey % 90 as id, case when s_suppkey % 7 = 0 then 'odd' else 'major' end as sev, case s_suppkey % 5 when 0 then 'units' when 1 then 'gone' end as lt from supplier)
 select id, 'duplicate_id' as violation from r group by id having count(*) > 1 union all select id, 'undeclared_severity' from r where sev = 'odd' union all select id, 'dangling_lookup' from r where lt = 'gone'""")
def _(t):
    k = F.col("s_suppkey")
    check = F.when(k % 5 == 0, '{"value_from":"lookup_tables.units"}').when(k % 5 == 1, '{"value_from":"lookup_tables.gone"}').otherwise('{"op":"exists"}')
    rules = t.supplier.select(F.concat(F.lit("r"), (k % 90).cast("string")).alias("id"), F.when(k % 7 == 0, "odd").otherwise("major").alias("severity"),
                              F.array(F.lit("major"), F.lit("minor")).alias("severities"), check.alias("check"), F.lit(None).cast("string").alias("applies_when"))
    lookups = t.region.where("r_regionkey = 0").select(F.lit("units").alias("table"))
    return S.rule_violations(rules, lookups)


@query("s4_corpus_violations", """with s as (select 's' || s_suppkey as id, case when s_suppkey % 20 = 3 then '' else s_name end as title, case when s_suppkey % 10 = 1 then 's' || (s_suppkey + 500) when s_suppkey % 10 = 2 then 's1' end as am, case when s_suppkey % 9 = 0 then '2025-01-01' end as f, case when s_suppkey % 9 = 0 then '2024-01-01' when s_suppkey % 9 = 1 then 'soon' end as u,
   case when s_suppkey % 8 = 0 then 'http://x.example.com/' when s_suppkey % 8 = 1 then 'https://u:p@x.example.com/' else 'https://x.example.com/a' end as url from supplier),
 p as (select 'p' || p_partkey % 1900 as id, 's' || p_partkey % 130 as src, case when p_partkey % 50 = 7 then '' else p_name end as tx, ['original','amended','superseded','draft'][p_partkey % 4 + 1] as st, p_partkey % 3 = 0 as cur, case when p_partkey % 25 = 0 then 'p' || (p_partkey + 90000) end as sup from part)
 select id, 'missing_field' as violation from s where title = '' union all select id, 'missing_field' from p where tx = '' union all select id, 'duplicate_id' from p group by id having count(*) > 1
 union all select id, 'unknown_source' from p where src not in (select id from s) union all select id, 'unknown_amended_source' from s where am not in (select id from s) union all select id, 'unknown_superseded_provision' from p where sup not in (select id from p)
 union all select id, 'date_range' from s where u is not null and (f > u or u = 'soon') union all select id, 'effective_status' from p where st = 'draft' union all select id, 'superseded_but_effective' from p where st = 'superseded' and cur union all select id, 'unsafe_url' from s where url not like 'https://x%'""")
def _(t):
    s, k = F.col("s_suppkey"), F.col("p_partkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    sources = t.supplier.select(
        name("s", s).alias("source_id"), F.when(s % 20 == 3, "").otherwise(F.col("s_name")).alias("title"), F.lit("c").alias("citation"),
        F.when(s % 10 == 1, name("s", s + 500)).when(s % 10 == 2, "s1").alias("amends_source_id"), F.when(s % 9 == 0, "2025-01-01").alias("effective_from"),
        F.when(s % 9 == 0, "2024-01-01").when(s % 9 == 1, "soon").alias("effective_until"),
        F.when(s % 8 == 0, "http://x.example.com/").when(s % 8 == 1, "https://u:p@x.example.com/").otherwise("https://x.example.com/a").alias("source_url"))
    states = F.array(*[F.lit(v) for v in ("original", "amended", "superseded", "draft")])
    none = F.lit(None).cast("string")
    provisions = t.part.select(
        name("p", k % 1900).alias("provision_id"), name("s", k % 130).alias("source_id"), F.when(k % 50 == 7, "").otherwise(F.col("p_name")).alias("text"), F.lit("c").alias("clause"),
        F.get(states, (k % 4).cast("int")).alias("effective_status"), (k % 3 == 0).alias("is_currently_effective"), F.when(k % 25 == 0, name("p", k + 90000)).alias("supersedes_provision_id"),
        none.alias("effective_from"), none.alias("effective_until"))
    return S.corpus_violations(sources, provisions)


def _truth_records(t):
    k = F.col("p_partkey")
    return t.part.select(F.when(k % 9 != 0, k.cast("string")).alias("product_id"), F.concat(F.lit("i"), (k % 1950).cast("string")).alias("image_id"),
                         F.array(F.lit("clean")).alias("capture_conditions"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("expected_fields"))


@query("s6_ground_truth", "select 'i' || p_partkey % 1950 as image_id, 'brand' as field, p_brand as expected from part union all select 'i' || p_partkey % 1950, 'type', p_type from part")
def _(t):
    return S.truth_rows(_truth_records(t))


@query("s6_ground_truth_violations", "select 'i' || p_partkey % 1950 as image_id, 'missing product_id' as violation from part where p_partkey % 9 = 0 union all select 'i' || p_partkey % 1950, 'duplicate_image_id' from part group by 1 having count(*) > 1")
def _(t):
    return S.truth_violations(_truth_records(t))


@query("s7_annotations", """select stem, 1 as line_no, class_id, error from (select p_partkey::varchar as stem, case p_partkey % 8 when 0 then 'x' else p_partkey % 6 end as c, case when p_partkey % 8 = 0 then null when p_partkey % 8 = 2 then p_partkey % 6 else p_partkey % 6 end as class_id,
  case when p_partkey % 8 = 2 then 'tokens' when p_partkey % 8 = 0 then 'class_not_integer' when p_partkey % 6 = 5 then 'class_out_of_range' when p_partkey % 8 = 4 then 'coordinates' when p_partkey % 8 = 6 then 'outside_frame' end as error from part where p_partkey % 10 <> 9) union all select p_partkey::varchar, 3, 0, null from part""")
def _(t):
    k = F.col("p_partkey")
    cls = F.when(k % 8 == 0, "x").otherwise((k % 6).cast("string"))
    box = F.when(k % 8 == 4, "0.5 0.5 1.5 0.2").when(k % 8 == 6, "0.9 0.5 0.4 0.2").otherwise("0.5 0.5 0.4 0.2")
    line = F.when(k % 10 == 9, "   ").when(k % 8 == 2, F.concat_ws(" ", cls, F.lit("0.5 0.5"))).otherwise(F.concat_ws(" ", cls, box))
    text = F.concat(line, F.lit("\r\n \n0 0.5 0.5 0.4 0.2\n"))
    files = t.part.select(F.lit("train").alias("split"), k.cast("string").alias("stem"), text.alias("text"))
    return S.annotations(S.annotation_lines(files), 5).select("stem", "line_no", F.col("class_id").cast("bigint").alias("class_id"), "error")


@query("s8_provenance_violations", """select split, image, concat_ws(',', case when em then 'empty_value' end, case when n < 0 then 'object_count' end, case when (st = 'positive' and n = 0) or (st = 'negative' and n <> 0) then 'count_disagrees' end, case when split = 'other' then 'split' end, case when st = 'odd' then 'rights_or_state' end, case when sh then 'digest' end) as violations
 from (select case when doc_id % 13 = 0 then 'other' else 'train' end as split, doc_id::varchar as image, doc_id % 11 = 0 as em, (doc_id % 6 - 1)::int as n, case doc_id % 3 when 0 then 'positive' when 1 then 'negative' else case when doc_id % 5 = 0 then 'odd' else 'positive' end end as st, doc_id % 7 = 0 as sh from documents)
 where em or n < 0 or (st = 'positive' and n = 0) or (st = 'negative' and n <> 0) or split = 'other' or st = 'odd' or sh""")
def _(t):
    k = F.col("doc_id")
    digest = F.sha2("text", 256)
    rows = t.documents.select(
        F.when(k % 13 == 0, "other").otherwise("train").alias("split"), k.cast("string").alias("image"), F.when(k % 7 == 0, F.upper(digest)).otherwise(digest).alias("image_sha256"),
        F.sha2("lang", 256).alias("label_sha256"), F.sha2("source", 256).alias("product_identity_sha256"), "source", F.when(k % 11 == 0, " ").otherwise("cc").alias("license"),
        F.lit("snack").alias("category"), F.lit("op").alias("operator"), F.lit("operator_confirmed").alias("rights_confirmation"),
        F.when(k % 3 == 0, "positive").when(k % 3 == 1, "negative").otherwise(F.when(k % 5 == 0, "odd").otherwise("positive")).alias("annotation_status"),
        (k % 6 - 1).cast("int").alias("object_count"), F.lit(None).cast("string").alias("_corrupt"))
    return S.provenance_violations(rows)


@query("s8_provenance_conflicts", """select split || '/' || image as id, 'duplicate_image' as violation from (select 'train' as split, (doc_id % 900)::varchar as image from documents) group by 1 having count(*) > 1
 union all select product, 'product_in_several_splits' from (select sha256(source) as product, case when doc_id % 13 = 0 then 'val' else 'train' end as split from documents) where product is not null group by 1 having count(distinct split) > 1""")
def _(t):
    k = F.col("doc_id")
    rows = t.documents.select(F.lit("train").alias("split"), (k % 900).cast("string").alias("image"), F.lit(None).cast("string").alias("product_identity_sha256"))
    products = t.documents.select(F.when(k % 13 == 0, "val").otherwise("train").alias("split"), F.lit(None).cast("string").alias("image"), F.sha2("source", 256).alias("product_identity_sha256"))
    return S.provenance_conflicts(rows.unionByName(products))


@query("s9_report_rows", """select o_orderkey as scan_id, o_custkey as image_id, 'RPT-' || upper(substr(sha256(o_orderkey || '|' || o_custkey), 1, 12)) as report_id, o_orderdate::date as day from orders""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("image_id"), F.col("o_orderdate").alias("created_at"))
    return sinks.report_rows(rows).select("scan_id", "image_id", "report_id", "day")


@query("s12_laid_out", "select revision_id, review_status from revisions where review_status = 'UNDER_OFFICIAL_REVIEW' and created_at >= timestamp '1999-01-01'", ("revisions",))
def _(t):
    rows = t.view("revisions").withColumnRenamed("created_at", "submitted_at")
    laid = sinks.lay_out(rows, "revisions", 8)
    return laid.where("review_status = 'UNDER_OFFICIAL_REVIEW' and submitted_at >= timestamp_ntz '1999-01-01 00:00:00'").select("revision_id", "review_status")
