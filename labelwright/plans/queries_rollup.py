"""Queries of roll-ups, dashboards, dataset checks and metrics (survey A, J10, J11, J13 to J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import measures as M
from labelwright.functions import patterns as P
from labelwright.operators import evidence as E
from labelwright.operators.lines import emit
from labelwright.operators import metrics as X
from labelwright.operators import quality as Q
from labelwright.operators import rollup as A
from labelwright.plans.queries_evidence import _ALONE, tok
from labelwright.plans.queries_lines import _AMT, _CONTEXT_SQL, _PRICE_SQL, q
from labelwright.plans.queries_rules import RULES_SQL, rule_results
from labelwright.plans.registry import query

WIDE = ("wide_facts",)

_STATUSES = ("PASS", "FAIL", "PARTIAL", "NEEDS_MANUAL_VERIFICATION", "NOT_APPLICABLE")


def _checks(t):
    names = F.array(*[F.lit(s) for s in _STATUSES])
    k = F.col("l_orderkey") * 3 + F.col("l_linenumber") * F.when(F.col("l_orderkey") % 4 == 0, 5).otherwise(1)
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.get(names, (k % 5).cast("int")).alias("status"))


_CHECKS_SQL = "checks as (select l_orderkey as doc_id, ['PASS','FAIL','PARTIAL','NEEDS_MANUAL_VERIFICATION','NOT_APPLICABLE'][(l_orderkey * 3 + l_linenumber * case when l_orderkey % 4 = 0 then 5 else 1 end) % 5 + 1] as status from lineitem)"


def rollup_sql(source: str, key: str) -> str:
    return f"""select {key}, c as compliant, n as non_compliant, l as low_confidence, case when ap = 0 then 'NOT_APPLICABLE' when n > 0 then 'NON_COMPLIANT' when l > 0 then 'REVIEW_REQUIRED' else 'COMPLIANT' end as status,
 case when c + n > 0 then round(c * 100.0::double / (c + n), 2) end as score from (select {key}, count(*) filter (where status in ('PASS', 'COMPLIANT')) c, count(*) filter (where status in ('FAIL', 'PARTIAL', 'NON_COMPLIANT')) n,
 count(*) filter (where status in ('NEEDS_MANUAL_VERIFICATION', 'REVIEW_REQUIRED')) l, count(*) filter (where status <> 'NOT_APPLICABLE') ap from {source} group by {key})"""


@query("a1_rollup_checks", f"with {_CHECKS_SQL} {rollup_sql('checks', 'doc_id')}")
def _(t):
    return A.rollup_checks(_checks(t), ["doc_id"])


@query("a2_overall_status", f"""with {RULES_SQL} select doc_id, case when bool_or(status = 'FAIL') then 'NON_COMPLIANT' when bool_or(status in ('REVIEW_REQUIRED', 'NOT_ASSESSED')) then 'REVIEW_REQUIRED' when bool_and(status = 'NOT_APPLICABLE') then 'NOT_APPLICABLE' else 'PASS' end as overall_status from rule_results group by 1""", WIDE)
def _(t):
    return A.overall_status(rule_results(t), ["doc_id"])


@query("a3_status_counts", f"""with {RULES_SQL} select doc_id, count(*) filter (where status = 'PASS') as pass, count(*) filter (where status = 'FAIL') as fail, count(*) filter (where status = 'REVIEW_REQUIRED') as review_required,
 count(*) filter (where status = 'NOT_APPLICABLE') as not_applicable, count(*) filter (where status = 'NOT_ASSESSED') as not_assessed, count(*) as total, count(*) filter (where has_check) as with_check, count(*) filter (where not has_check) as without_check from rule_results group by 1""", WIDE)
def _(t):
    return A.status_counts(rule_results(t), ["doc_id"])


# The flagship: label lines to price, quantity and unit-price checks, to a status per label and counts per brand.
_QTEST = f"regexp_matches(text, {q(P.QUANTITY)})"
FLAGSHIP_SQL = f"""{_PRICE_SQL}, {_CONTEXT_SQL},
 lone as (select doc_id from (select doc_id, string_agg(text, chr(10) order by n) t from label_lines group by 1) where len(regexp_extract_all(t, {q(P.CURRENCY_AMOUNT)})) = 1 and not regexp_matches(t, '(?i)unit\\s+sale|price\\s+per|/kg|/g|/l')),
 pv as (select doc_id, value from price where {_AMT.replace('text', 'value')} union all select k.doc_id, k.text from kw k join lone using (doc_id) where k.field = 'maximum_retail_price_mrp' and not exists (select 1 from pk where pk.doc_id = k.doc_id)),
 qn as (select k.doc_id, k.text, arg_min(c.text, c.n) as nxt from kw k left join ctx c on c.doc_id = k.doc_id and c.n between k.n + 1 and k.n + 6 and not c.near and regexp_matches(c.text, {q(P.QUANTITY)}) where field = 'net_quantity' group by 1, 2),
 qv as (select doc_id, case when {_QTEST} or nxt is null then text else text || ' ' || nxt end as value from qn),
 uv as (select doc_id, text as value from kw where field = 'unit_sale_price'),
 vals as (select doc_id, 'maximum_retail_price_mrp' as field, value from pv union all select doc_id, 'net_quantity', value from qv union all select doc_id, 'unit_sale_price', value from uv),
 dt as (select *, {tok('text')} as tok, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as nt from detections),
 ev as (select v.doc_id, v.field, round(avg(d.confidence), 4) as c from (select *, {tok('value')} as needle from vals) v join dt d on d.doc_id = v.doc_id and length(tok) > 2 and length(needle) > 2
  and (contains(needle, tok) or contains(tok, needle)) and (tok = needle or nt > 1 or tok in ({_ALONE})) group by 1, 2),
 page as (select doc_id, avg(confidence) pc from detections group by 1),
 fv as (select v.*, coalesce(ev.c, pc) as conf from vals v left join ev using (doc_id, field) join page using (doc_id)),
 chk as (select p.p_partkey as doc_id, f.field, fv.value, fv.conf, qf.value as qvalue from part p cross join (values ('maximum_retail_price_mrp'), ('net_quantity'), ('unit_sale_price')) f(field)
  left join fv on fv.doc_id = p.p_partkey and fv.field = f.field left join qv qf on qf.doc_id = p.p_partkey),
 st as (select doc_id, field, case field
   when 'maximum_retail_price_mrp' then case when conf >= 0.8 and len(case when len(regexp_extract_all(value, {q(P.CURRENCY_AMOUNT)})) > 0 then regexp_extract_all(value, {q(P.CURRENCY_AMOUNT)}) when regexp_matches(value, {q(P.LABELLED_AMOUNT)}) then ['x'] else [] end) = 1
      and regexp_matches(value, {q(P.PRICE_LABEL)}) and regexp_matches(value, {q(P.TAX_WORDING)}) then 'PASS' else 'NEEDS_MANUAL_VERIFICATION' end
   when 'net_quantity' then case when conf >= 0.8 and regexp_matches(value, {q(P.QUANTITY)}) then 'PASS' else 'NEEDS_MANUAL_VERIFICATION' end
   else case when value is not null then case when conf >= 0.8 and regexp_matches(value, {q(P.UNIT_PRICE)}) then 'PASS' else 'NEEDS_MANUAL_VERIFICATION' end
      when regexp_matches(qvalue, {q(P.QUANTITY)}) and abs(try_cast(regexp_extract(qvalue, {q(P.QUANTITY)}, 1) as double) * case when lower(regexp_extract(qvalue, {q(P.QUANTITY)}, 2)) in ('kg', 'l') then 1000 else 1 end - 1000) < 0.01 then 'PASS' else 'NEEDS_MANUAL_VERIFICATION' end end as status from chk)"""
FLAGSHIP_FIELDS = ["maximum_retail_price_mrp", "net_quantity", "unit_sale_price"]


def checked_labels(t, profile):
    """Labels with their fields and checks in the row; nothing is shuffled up to here."""
    return A.check_documents(E.with_fields(t.label_docs, [*profile, "net_quantity"]), 2026, 6, profile)


def flagship_checks(t, profile):
    return emit(checked_labels(t, profile), F.col("checks"))


@query("a4_checks_from_field_table", f"with {FLAGSHIP_SQL} select doc_id, field, status from st", ("keywords", "detections"))
def _(t):
    return A.field_checks(E.extract_fields(t.label_docs), 2026, 6, FLAGSHIP_FIELDS)


@query("a4_field_checks", f"with {FLAGSHIP_SQL} select doc_id, field, status from st", ("keywords", "detections"))
def _(t):
    return flagship_checks(t, FLAGSHIP_FIELDS)


@query("a4_retail_checks")
def _(t):
    return flagship_checks(t, P.RETAIL_FIELDS)


@query("a4_wholesale_checks")
def _(t):
    return flagship_checks(t, P.WHOLESALE_FIELDS)


@query("label_compliance_by_brand", f"""with {FLAGSHIP_SQL}, ru as ({rollup_sql('st', 'doc_id')})
 select p_brand as brand, status, count(*) as labels, sum(compliant)::bigint as passed_checks, round(avg(score), 4) as mean_score from ru join part on p_partkey = doc_id group by 1, 2""", ("keywords", "detections"))
def _(t):
    status = A.rollup_in_row(checked_labels(t, FLAGSHIP_FIELDS))
    return status.groupBy("brand", "status").agg(
        F.count("*").alias("labels"), F.sum("compliant").alias("passed_checks"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("a5_summary", """with c as (select l_orderkey as doc_id, 'f' || l_linenumber as field, ['PASS','FAIL','PARTIAL','NEEDS_MANUAL_VERIFICATION','NOT_APPLICABLE'][(l_orderkey + l_linenumber) % 5 + 1] as status from lineitem)
 select doc_id, count(*) as total, count(*) filter (where status = 'PASS') as passed, count(*) filter (where status = 'FAIL') as failed, count(*) filter (where status = 'PARTIAL') as partial, count(*) filter (where status = 'NEEDS_MANUAL_VERIFICATION') as manual_verification,
  count(*) filter (where status = 'NOT_APPLICABLE') as not_applicable, coalesce(string_agg(distinct field, ',' order by field) filter (where status in ('FAIL', 'PARTIAL')), '') as missing_fields,
  case when count(*) filter (where status = 'NEEDS_MANUAL_VERIFICATION') > 0 then count(*) filter (where status = 'NEEDS_MANUAL_VERIFICATION') || ' check(s) could not be verified' end as warning from c group by 1""")
def _(t):
    names = F.array(*[F.lit(s) for s in _STATUSES])
    checks = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"),
                               F.get(names, ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int")).alias("status"))
    return A.summary(checks)


_CASE_STATUS = "['open','under_review','escalated','closed'][event_id % 4 + 1]"


@query("a6_official_dashboard", f"""with s as (select product_id % 50 as owner, created_at, score, case when revision_id % 3 = 0 then 'compliant' else 'flagged' end as status from revisions),
 a as (select owner, count(*) n, count(*) filter (where created_at::date = date '1998-06-15') td, count(score) sc, count(*) filter (where status = 'compliant' and score is not null) g from s group by 1),
 c as (select user_id % 60 as owner, count(*) filter (where {_CASE_STATUS} in ('open','under_review','escalated')) o, count(*) filter (where {_CASE_STATUS} = 'escalated') e, count(*) filter (where {_CASE_STATUS} = 'closed') cl from events where event_type = 'error' group by 1)
 select coalesce(a.owner, c.owner) as owner, coalesce(n, 0) as total_scans, coalesce(td, 0) as scans_today, coalesce(o, 0) as open_violations, coalesce(e, 0) as escalated, coalesce(cl, 0) as closed, coalesce(round(g * 100.0 / nullif(sc, 0)), 0)::bigint as compliance_rate from a full outer join c on a.owner = c.owner""", ("revisions",))
def _(t):
    scans = t.view("revisions").select((F.col("product_id") % 50).alias("owner"), F.col("created_at").alias("date"), "score",
                                       F.when(F.col("revision_id") % 3 == 0, "compliant").otherwise("flagged").alias("status"))
    names = F.array(*[F.lit(s) for s in ("open", "under_review", "escalated", "closed")])
    cases = t.events.where("event_type = 'error'").select((F.col("user_id") % 60).alias("owner"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("case_status"))
    return A.official_dashboard(scans, cases, "owner", F.lit("1998-06-15").cast("date"))


@query("a7_manufacturer_dashboard", """select product_id % 50 as owner, count(*) as total_products, count(*) filter (where revision_id % 3 = 0) as compliant_products, count(*) filter (where revision_id % 3 <> 0) as needs_fixes, coalesce(round(avg(score)), 0)::bigint as compliance_score from revisions group by 1""", ("revisions",))
def _(t):
    products = t.view("revisions").select((F.col("product_id") % 50).alias("owner"), "score", F.when(F.col("revision_id") % 3 == 0, "compliant").otherwise("flagged").alias("status"))
    return A.manufacturer_dashboard(products, "owner")


@query("a8_capture_completeness", """with p as (select l_orderkey as doc_id, lower(trim(['Front panel ','BACK','label panel','side','front-side'][l_linenumber % 5 + 1])) as raw from lineitem),
 n as (select doc_id, case when raw in ('front panel', 'front-side') then 'front' when raw = 'label panel' then 'label' else raw end as panel from p)
 select doc_id, concat_ws(',', case when not bool_or(panel = 'front') then 'front' end, case when not bool_or(panel = 'back') then 'back' end, case when not bool_or(panel = 'label') then 'label' end) as missing_panels,
  bool_or(panel = 'front') and bool_or(panel = 'back') and bool_or(panel = 'label') as complete from n group by 1""")
def _(t):
    names = F.array(*[F.lit(s) for s in ("Front panel ", "BACK", "label panel", "side", "front-side")])
    return A.capture_completeness(t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.get(names, F.col("l_linenumber") % 5).alias("panel")))


SPLITS = ["train", "val", "test"]
_SPLIT_SQL = "case when doc_id % 10 <= 6 then 'train' when doc_id % 10 <= 8 then 'val' else 'test' end"


def images(t):
    k = F.col("doc_id")
    split = F.when(k % 10 <= 6, "train").when(k % 10 <= 8, "val").otherwise("test")
    return t.documents.select(k.alias("image_id"), split.alias("split"), "source", "lang", F.sha2("text", 256).alias("digest"), "n_chars",
                              F.when(k % 8 != 0, F.sha2(F.concat(F.lit("l"), k.cast("string")), 256)).alias("label_digest"))


_IMAGES_SQL = f"images as (select doc_id as image_id, {_SPLIT_SQL} as split, source, lang, sha256(text) as digest, n_chars, case when doc_id % 8 <> 0 then sha256('l' || doc_id) end as label_digest from documents)"


@query("a9_class_balance", f"""select c.class_id, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test from (values (0), (1), (2), (3)) c(class_id)
 left join (select quality + 2 * toxic as class_id, {_SPLIT_SQL} as split from labels) l using (class_id) group by 1""")
def _(t):
    k = F.col("doc_id")
    labels = t.labels.select((F.col("quality") + 2 * F.col("toxic")).alias("class_id"), F.when(k % 10 <= 6, "train").when(k % 10 <= 8, "val").otherwise("test").alias("split"))
    return Q.class_balance(labels, SPLITS, [0, 1, 2, 3])


@query("a9_zero_classes", f"""select s.split, c.class_id from (values (0), (1), (2), (3), (4)) c(class_id) cross join (values ('train'), ('val'), ('test')) s(split) where not exists (select 1 from (select quality + 2 * toxic as class_id, {_SPLIT_SQL} as split from labels) l where l.class_id = c.class_id and l.split = s.split)""")
def _(t):
    k = F.col("doc_id")
    labels = t.labels.select((F.col("quality") + 2 * F.col("toxic")).alias("class_id"), F.when(k % 10 <= 6, "train").when(k % 10 <= 8, "val").otherwise("test").alias("split"))
    return Q.zero_classes(Q.class_balance(labels, SPLITS, [0, 1, 2, 3, 4]), SPLITS)


@query("a10_dataset_report", f"""with {_IMAGES_SQL} select 'split' as dimension, split as value, count(*) as n from images group by 2 union all select 'source', source, count(*) from images group by 2 union all select 'lang', lang, count(*) from images group by 2
 union all select 'condition', c, count(*) from (select unnest(case when n_chars > 500 then ['long', lang] else [lang] end) as c from images) group by 2""")
def _(t):
    conditions = F.array_compact(F.array(F.when(F.col("n_chars") > 500, "long"), F.col("lang"), F.col("lang")))
    return Q.dataset_report(images(t).withColumn("conditions", conditions), ["split", "source", "lang"], "conditions")


@query("a11_exact_duplicates", f"""with {_IMAGES_SQL} select digest, count(*) as copies, min(image_id) as first_image, string_agg(distinct split, ',' order by split) as splits, case when count(distinct split) > 1 then 'leakage' else 'duplicate' end as severity from images group by 1 having count(*) > 1""")
def _(t):
    return Q.exact_duplicates(images(t))


@query("a11_duplicate_members", f"""with {_IMAGES_SQL}, g as (select digest, case when count(distinct split) > 1 then 'leakage' else 'duplicate' end as severity from images group by 1 having count(*) > 1) select image_id, split, digest, severity from images join g using (digest)""")
def _(t):
    rows = images(t)
    return Q.duplicate_members(rows, Q.exact_duplicates(rows))


@query("a12_identity_leakage", f"with {_IMAGES_SQL}, i as (select *, n_chars || lang as identity from images) select identity, count(*) as images, string_agg(distinct split, ',' order by split) as splits from i group by 1 having count(distinct split) > 1")
def _(t):
    return Q.identity_leakage(images(t).withColumn("identity", F.concat(F.col("n_chars").cast("string"), "lang")), "identity")


@query("a13_split_manifest", f"""with {_IMAGES_SQL}, h as (select split, sha256(concat_ws('|', image_id::varchar, digest, coalesce(label_digest, ''))) as h, label_digest is not null as l from images),
 b as (select split, ('0x' || substr(h, 1, 8))::bigint % 4096 as b, count(*) n, count(*) filter (where l) nl, sha256(string_agg(h, chr(10) order by h)) d from h group by 1, 2)
 select split, sum(n)::bigint as images, sum(nl)::bigint as labelled, sha256(string_agg(d, chr(10) order by b)) as manifest, 'present' as status from b group by 1""")
def _(t):
    return Q.split_manifest(images(t))


def _truth(t):
    k = F.col("doc_id")
    base = t.view("base_fields")
    status = k % 6 == 0
    expected = F.when(status, "PASS").when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.lit("nothing like it")).otherwise(F.upper(F.substring("value", 1, 6)))
    truth = base.select(k.alias("image_id"), "field", expected.alias("expected"), status.alias("is_status"))
    actual = base.where(k % 4 != 0).select(k.alias("image_id"), "field", F.when((k % 12 == 6), "PASS").otherwise(F.col("value")).alias("actual"), (k % 3).alias("n_regions"))
    return truth, actual


_TRUTH_SQL = """tj as (select b.doc_id as image_id, b.field, case when b.doc_id % 6 = 0 then 'PASS' when b.doc_id % 7 = 0 then null when b.doc_id % 5 = 0 then 'nothing like it' else upper(substr(value, 1, 6)) end as expected,
  case when b.doc_id % 4 <> 0 then case when b.doc_id % 12 = 6 then 'PASS' else value end end as actual, case when b.doc_id % 4 <> 0 then b.doc_id % 3 end as nr, b.doc_id % 6 = 0 as st from base_fields b),
 tm as (select *, case when st then coalesce(actual = expected, false) when expected is null then actual is null else contains(lower(coalesce(actual, '')), lower(trim(expected))) end as matched from tj)"""


@query("j15_truth_join", f"with {_TRUTH_SQL} select image_id, field, expected, actual, matched from tm", ("base_fields",))
def _(t):
    return X.truth_join(*_truth(t)).select("image_id", "field", "expected", "actual", "matched")


@query("a14_extraction_metrics", f"with {_TRUTH_SQL} select field, count(*) as checks, count(*) filter (where matched) as matches, round(avg(matched::int), 6) as accuracy, round(avg(case when nr > 0 then 1 else 0 end), 6) as evidence_coverage from tm group by 1", ("base_fields",))
def _(t):
    out = X.extraction_metrics(X.truth_join(*_truth(t)), ["field"])
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("evidence_coverage", F.round("evidence_coverage", 6))


@query("a15_percentile", """select event_type, value from (select event_type, value, row_number() over (partition by event_type order by value) rn, count(*) over (partition by event_type) n from events) where rn = round_even(0.95 * (n - 1), 0) + 1""")
def _(t):
    return X.nearest_rank_percentile(t.events, ["event_type"], "value", 95)


@query("a15_median", "select event_type, median(value) as value from events group by 1")
def _(t):
    return X.median(t.events, ["event_type"], "value")


@query("a15_overall_percentile", "select l_extendedprice as value from (select l_extendedprice, row_number() over (order by l_extendedprice) rn, count(*) over () n from lineitem) where rn = round_even(0.95 * (n - 1), 0) + 1")
def _(t):
    return X.nearest_rank_percentile(t.lineitem, [], "l_extendedprice", 95)


@query("a16_regressions", "select a.event_type as metric, a.v as current, b.v as baseline, round(a.v - b.v, 6) as delta from (select event_type, round(avg(value), 6) v from events where user_id % 2 = 0 group by 1) a join (select event_type, round(avg(value), 6) v from events where user_id % 2 = 1 group by 1) b using (event_type)")
def _(t):
    mean = lambda c: t.events.where(c).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return X.regressions(mean("user_id % 2 = 0"), mean("user_id % 2 = 1")).withColumn("delta", F.round("delta", 6))


@query("a17_outcome_classes", """select outcome, count(*) as n from (select case g when 'legible' then case when d then 'CORRECT' else 'FALSE_NOT_DETECTED' end when 'blank' then case s when 'NEEDS_MANUAL_VERIFICATION' then 'LEGITIMATE_REVIEW' when 'PASS' then 'FALSE_PASS' else 'GROUND_TRUTH_UNAVAILABLE' end else 'GROUND_TRUTH_UNAVAILABLE' end as outcome
 from (select case l_linenumber % 3 when 0 then 'legible' when 1 then 'blank' end as g, l_quantity > 10 as d, case when l_returnflag = 'A' then 'PASS' when l_returnflag = 'N' then 'NEEDS_MANUAL_VERIFICATION' else 'FAIL' end as s from lineitem)) group by 1""")
def _(t):
    n = F.col("l_linenumber") % 3
    rows = t.lineitem.select(F.when(n == 0, "legible").when(n == 1, "blank").alias("ground_truth"), (F.col("l_quantity") > 10).alias("detected"),
                             F.when(F.col("l_returnflag") == "A", "PASS").when(F.col("l_returnflag") == "N", "NEEDS_MANUAL_VERIFICATION").otherwise("FAIL").alias("status"))
    return X.outcome_classes(rows).groupBy("outcome").agg(F.count("*").alias("n"))


_HINT_SQL = " ".join(f"when '{f}' then " + " or ".join(f"contains(lower(text), '{h}')" for h in hints) for f, hints in P.FAILURE_HINTS.items())


@query("a18_failure_source", f"""with r as (select d.doc_id, f.field, d.text, d.doc_id % 2 = 0 as det, d.doc_id % 3 as nr from documents d cross join (values {", ".join(f"('{f}')" for f in P.FAILURE_HINTS)}) f(field)),
 h as (select *, case field {_HINT_SQL} end as hint from r)
 select field, case when not hint then 'OCR' when not det then 'Extraction' else 'Confidence' end || case when det and nr = 0 then ',Evidence' else '' end as sources, count(*) as n from h group by 1, 2""")
def _(t):
    k = F.col("doc_id")
    rows = t.documents.select("doc_id", "text", (k % 2 == 0).alias("detected"), (k % 3).alias("n_regions"), F.explode(F.array(*[F.lit(f) for f in P.FAILURE_HINTS])).alias("field"))
    return X.failure_source(rows).groupBy("field", F.array_join("sources", ",").alias("sources")).agg(F.count("*").alias("n"))


@query("a19_latency_profile", """with m as (select avg(l_quantity) a, avg(l_extendedprice) b, avg(l_discount) c from lineitem where l_returnflag <> 'R') select 'ocr' as stage, round(a, 6) as mean_ms from m union all select 'extraction', round(b, 6) from m union all select 'rules', round(c, 6) from m""")
def _(t):
    runs = t.lineitem.select((F.col("l_returnflag") != "R").alias("success"), F.col("l_quantity").alias("ocr"), F.col("l_extendedprice").alias("extraction"), F.col("l_discount").alias("rules"))
    return X.latency_profile(runs, ["ocr", "extraction", "rules"]).withColumn("mean_ms", F.round("mean_ms", 6))


@query("a20_distinct_shapes", f"""with t as (select doc_id, string_agg(text, chr(10) order by n) as text from label_lines group by 1), c as (select doc_id, len(list_distinct(regexp_extract_all(text, {q(P.PRICE_LIKE)})))::int as prices, len(list_distinct(regexp_extract_all(text, {q(P.QUANTITY_LIKE)})))::int as quantities from t)
 select *, concat_ws(',', case when prices >= 2 then 'multiple_price_numbers' end, case when quantities >= 2 then 'multiple_weight_numbers' end) as tags from c""", ("label_lines",))
def _(t):
    return X.distinct_shapes(t.label_docs.select("doc_id", F.array_join("lines", "\n").alias("text")))


@query("a21_confusion", """with p as (select case when n_chars > 400 then 1 else 0 end as pred, quality as truth from labels join documents using (doc_id)), c as (select pred as class_id, count(*) filter (where pred = truth) tp, count(*) filter (where pred <> truth) fp, 0 fn from p group by 1 union all select truth, 0, 0, count(*) filter (where pred <> truth) from p group by 1),
 s as (select class_id, sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn from c group by 1) select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, tp + fn > 0 as has_instances from s""")
def _(t):
    pairs = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("pred"), F.col("quality").alias("truth"))
    return X.confusion(pairs).withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query("a22_confidence_gate", """select decision, count(*) as n, round(sum(score), 6) as total from (select case when bad or z then 0.0::double else sc end as score, case when not bad and not z and sc >= 0.9 then 'proceed' else 'officer_review' end as decision from (select *, a > 1 as bad, d = 0 as z, round(case when d = 0 then 0 else 4.0::double / (1 / a + 1 / b + 1 / c + 1 / d) end, 12) as sc from
 (select 0.8 + l_discount * 2.5::double as a, 0.95::double as b, 0.99 - l_tax / 2 as c, case when l_linenumber = 7 then 0.0::double else 0.97::double end as d from lineitem))) group by 1""")
def _(t):
    rows = t.lineitem.select((0.8 + F.col("l_discount") * 2.5).alias("a"), F.lit(0.95).alias("b"), (0.99 - F.col("l_tax") / 2).alias("c"), F.when(F.col("l_linenumber") == 7, 0.0).otherwise(0.97).alias("d"))
    return X.confidence_gate(rows, ["a", "b", "c", "d"]).groupBy("decision").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("a23_corpus_status", """select state, count(*) as sources, sum(c)::bigint as provisions from (select s_suppkey, ['verified','partial','blocked','unresolved'][s_suppkey % 4 + 1] as state, (select count(*) from part where p_partkey % 100 = s_suppkey) as c from supplier) group by 1""")
def _(t):
    names = F.array(F.lit("verified"), F.lit("partial"), F.lit("blocked"), F.lit(None))
    sources = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.get(names, (F.col("s_suppkey") % 4).cast("int")).alias("verification_status"))
    return X.corpus_status(sources, t.part.select((F.col("p_partkey") % 100).alias("source_id")))


@query("a26_weighted_median", """with w as (select l_suppkey, l_discount * 100 as v, l_quantity as w from lineitem), m as (select l_suppkey, v, sum(sum(w)) over (partition by l_suppkey order by v) cum, sum(sum(w)) over (partition by l_suppkey) tot from w group by 1, 2)
 select l_suppkey, round(min(v), 6) as value, 'assessed' as status from m where cum >= tot / 2 group by 1""")
def _(t):
    rows = t.lineitem.select("l_suppkey", (F.col("l_discount") * 100).alias("v"), F.col("l_quantity").alias("w"))
    return X.weighted_median(rows, "l_suppkey", "v", "w").withColumn("value", F.round("value", 6))


@query("a28_quality_verdict", """select reasons, acceptable, count(*) as n, round(avg(o), 4) as overall from (select o, rs as reasons, rs = '' as acceptable from (select o, concat_ws(',', case when w < 640 then 'resolution' end, case when b > 0.45 then 'blur' end, case when g > 0.60 then 'glare' end, case when abs(sk) > 8 then 'skew' end, case when o < 0.55 then 'overall' end) as rs
 from (select *, round(greatest(0, least(1, s * 0.9 + (1 - g) * 0.1)), 4) as o from (select 600 + l_linenumber * 30 as w, l_quantity / 50 as s, 1 - l_quantity / 50 as b, l_tax * 10 as g, l_discount * 100 - 1 as sk from lineitem)))) group by 1, 2""")
def _(t):
    q_ = F.col("l_quantity") / 50
    rows = t.lineitem.select((600 + F.col("l_linenumber") * 30).alias("width"), F.lit(480).alias("height"), q_.alias("sharpness"), (1 - q_).alias("blur"), (F.col("l_tax") * 10).alias("glare"), (F.col("l_discount") * 100 - 1).alias("skew_degrees"))
    return X.quality_verdict(rows).groupBy(F.array_join("reasons", ",").alias("reasons"), "acceptable").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 4).alias("overall"))


@query("j10_referential_gaps", "select p_partkey, supplier_id from (select p_partkey, case when p_partkey % 3 <> 0 then p_partkey % 130 end as supplier_id from part) where supplier_id is not null and supplier_id not in (select s_suppkey from supplier)")
def _(t):
    child = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 130).alias("supplier_id"))
    return Q.referential_gaps(child, t.supplier, "supplier_id", "s_suppkey")


@query("j11_unknown_rules", "select event_id, event_type as rule_id from events where event_type not in ('click', 'view', 'error')")
def _(t):
    rules = t.events.where("event_type in ('click', 'view', 'error')").select(F.col("event_type").alias("rule_id"))
    return Q.known_rule(t.events.select("event_id", F.col("event_type").alias("rule_id")), rules, known=False)


@query("j13_images_vs_labels", f"""with {_IMAGES_SQL} select split, image_id as stem, 'unlabelled' as problem from images where image_id % 7 = 0 union all select split, image_id + 5000000, 'orphan_label' from images where image_id % 7 <> 0 and image_id % 11 = 0""")
def _(t):
    rows = images(t).select("split", F.col("image_id").alias("stem"))
    labels = rows.where("stem % 7 <> 0")
    return Q.images_vs_labels(rows, labels.unionByName(labels.where("stem % 11 = 0").withColumn("stem", F.col("stem") + 5000000)))


@query("j14_provenance_check", f"""with {_IMAGES_SQL} select split, image_id as image, case when image_id % 9 = 0 then 'no_provenance' when image_id % 10 = 3 then 'digest_mismatch' when label_digest is null then 'no_annotation' when image_id % 13 = 4 then 'count_mismatch' end as problem from images
 where image_id % 9 = 0 or image_id % 10 = 3 or label_digest is null or image_id % 13 = 4 union all select split, image_id + 7000000, 'extra_metadata' from images where image_id % 17 = 0 and image_id % 9 <> 0""")
def _(t):
    k = F.col("image")
    rows = images(t).withColumnRenamed("image_id", "image").withColumn("objects", (k % 4))
    p = rows.where(k % 9 != 0).select("split", "image", F.when(k % 10 == 3, "x").otherwise(F.col("digest")).alias("image_digest"), "label_digest",
                                      (F.col("objects") + F.when(k % 13 == 4, 1).otherwise(0)).alias("object_count"))
    extra = p.where(k % 17 == 0).withColumn("image", k + 7000000)
    return Q.provenance_check(rows.select("split", "image", "digest", "label_digest", "objects"), p.unionByName(extra))
