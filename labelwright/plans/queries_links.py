"""Queries of record linkage and integrity (survey J1 to J6, J12, J16 to J18, A24, A25, A27, I, S11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.operators import integrity as I
from labelwright.operators import joins as J
from labelwright.plans.queries_lines import q
from labelwright.functions import patterns as P
from labelwright.plans.registry import query


@query("j1_queue_with_identity", """select revision_id, manufacturer_id, coalesce(c_name, 'Unknown') as manufacturer_name, coalesce(c_mktsegment, '') as manufacturer_company, coalesce('m' || c_custkey || '@example.com', '') as manufacturer_email
 from revisions left join customer on c_custkey = manufacturer_id where review_status in ('PENDING_OFFICIAL_REVIEW', 'UNDER_OFFICIAL_REVIEW')""", ("revisions",))
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("company"),
                              F.concat(F.lit("m"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"))
    queue = t.view("revisions").where("review_status in ('PENDING_OFFICIAL_REVIEW', 'UNDER_OFFICIAL_REVIEW')")
    return J.queue_with_identity(queue, users).select("revision_id", "manufacturer_id", "manufacturer_name", "manufacturer_company", "manufacturer_email")


def _amount(c: str) -> str:
    return f"(try_cast(regexp_extract({c}, {q(P.QUANTITY)}, 1) as double) * case when lower(regexp_extract({c}, {q(P.QUANTITY)}, 2)) in ('kg', 'l') then 1000 else 1 end)"


def _basis(c: str) -> str:
    return f"(case when lower(regexp_extract({c}, {q(P.QUANTITY)}, 2)) in ('kg', 'g') then 'w' else 'v' end)"


_COUNTRY = "lower(rtrim(trim(regexp_replace(regexp_replace(trim({c}), '(?i)^(?:made\\s+in|product\\s+of|country\\s+of\\s+origin\\s*:?)\\s*', ''), '\\s+', ' ', 'g')), '.'))"
_MONEY = "try_cast(regexp_extract(replace({c}, ',', ''), '[0-9]+(?:\\.[0-9]{{1,2}})?', 0) as double)"
COMPARE_SQL = f"""cmp as (select l.doc_id, f.field, p.value as pv, case f.field when 'net_quantity' then net_quantity when 'country_of_origin' then country_of_origin when 'maximum_retail_price_mrp' then mrp else coalesce(manufacturer, packer_importer) end as lv
  from listing l cross join (values ('net_quantity'), ('country_of_origin'), ('manufacturer_packer_importer_details'), ('maximum_retail_price_mrp')) f(field) left join physical p on p.doc_id = l.doc_id and p.field = f.field where retrieval_status = 'SUCCESS'),
 outc as (select doc_id, field, pv as physical_value, lv as listing_value, case when pv is null and lv is null then 'NOT_APPLICABLE' when pv is null then 'PHYSICAL_FIELD_UNAVAILABLE' when lv is null then 'LISTING_FIELD_UNAVAILABLE'
  when field = 'net_quantity' then case when {_amount('pv')} is null or {_amount('lv')} is null or {_basis('pv')} <> {_basis('lv')} then 'REVIEW_REQUIRED' when abs({_amount('pv')} - {_amount('lv')}) / {_amount('pv')} <= 0.005 then 'MATCH' else 'MISMATCH' end
  when field = 'country_of_origin' then case when {_COUNTRY.format(c='pv')} = {_COUNTRY.format(c='lv')} then 'MATCH' else 'MISMATCH' end
  when field = 'maximum_retail_price_mrp' then case when {_MONEY.format(c='pv')} is null or {_MONEY.format(c='lv')} is null then 'REVIEW_REQUIRED' when abs({_MONEY.format(c='pv')} - {_MONEY.format(c='lv')}) <= 0.01 then 'MATCH' else 'MISMATCH' end
  else case when contains(lower(pv), lower(lv)) or contains(lower(lv), lower(pv)) then 'MATCH' else 'REVIEW_REQUIRED' end end as outcome from cmp)"""
CMP = ("listing", "physical")


def comparisons(t):
    return J.compare_records(t.view("physical_fields"), t.view("listing"))


@query("j2_compare_records", f"with {COMPARE_SQL} select * from outc", CMP)
def _(t):
    return comparisons(t)


for _name, _field in (("j2a_compare_quantity", "net_quantity"), ("j2b_compare_country", "country_of_origin"),
                      ("j2c_compare_price", "maximum_retail_price_mrp"), ("j2d_compare_manufacturer", "manufacturer_packer_importer_details")):
    def _one(t, field=_field):
        return comparisons(t).where(F.col("field") == field).groupBy("field", "outcome").agg(F.count("*").alias("n"))
    query(_name, f"with {COMPARE_SQL} select field, outcome, count(*) as n from outc where field = '{_field}' group by 1, 2", CMP)(_one)


@query("a24_comparison_counts", f"with {COMPARE_SQL} select doc_id, count(*) filter (where outcome = 'MISMATCH') as mismatches, count(*) filter (where outcome = 'REVIEW_REQUIRED') as reviews from outc group by 1", CMP)
def _(t):
    return J.comparison_counts(comparisons(t))


_CHECK13 = "substr(d, 13, 1)::int = (10 - list_sum(list_transform(range(0, 12), lambda i: substr(d, (12 - i)::int, 1)::int * case when i % 2 = 0 then 3 else 1 end))::int % 10) % 10"
GTIN_SQL = f"""gt as (select *, case when not regexp_matches(d, '^[0-9]+$') then 'MALFORMED_IDENTIFIER' when sy = 'UPC_E' then 'VALID_GTIN' when sy is not null and sy <> 'EAN_13' then 'UNSUPPORTED_IDENTIFIER' when {_CHECK13} then 'VALID_GTIN' else 'INVALID_GTIN' end as gtin_status
  from (select *, replace(raw_value, '-', '') as d, case when symbology = 'UPC-E' then 'UPC_E' when symbology = 'ean 13' then 'EAN_13' else symbology end as sy from barcodes)),
 gg as (select *, case when gtin_status = 'VALID_GTIN' then case when sy = 'UPC_E' then '042100005264' else d end end as gtin from gt)"""


@query("i1_audit_gtin", f"with {GTIN_SQL} select doc_id, raw_value, gtin, gtin_status from gg", ("barcodes",))
def _(t):
    return I.audit_gtin(t.view("barcodes")).select("doc_id", "raw_value", "gtin", "gtin_status")


@query("i1_gtin_profile", f"with {GTIN_SQL} select gtin_status, count(*) as n from gg group by 1", ("barcodes",))
def _(t):
    return I.status_profile(I.audit_gtin(t.view("barcodes")), "gtin_status")


_REGISTRY_SQL = f"""{GTIN_SQL}, reg as (select gtin, min(case when doc_id % 4 = 0 then upper(p_brand) else p_brand || ' x' end) as rb, min(p_name) as rn, min(p_size || 'g') as rq from gg where gtin is not null and doc_id % 2 = 0 group by 1),
 lk as (select g.doc_id, g.raw_value, g.gtin, g.p_brand, g.p_name, g.p_size, reg.rb, reg.rn, reg.rq, case when g.gtin is null then 'NOT_ATTEMPTED' when reg.gtin is not null then 'VERIFIED' else 'NOT_FOUND' end as lookup_status from gg g left join reg on reg.gtin = g.gtin)"""


def _looked_up(t):
    codes = I.audit_gtin(t.view("barcodes"))
    k = F.col("doc_id")
    registry = codes.where("gtin is not null and doc_id % 2 = 0").groupBy("gtin").agg(
        F.min(F.when(k % 4 == 0, F.upper("p_brand")).otherwise(F.concat("p_brand", F.lit(" x")))).alias("rb"), F.min("p_name").alias("rn"),
        F.min(F.concat(F.col("p_size").cast("string"), F.lit("g"))).alias("rq"))
    return J.registry_lookup(codes, registry)


@query("j3_registry_lookup", f"with {_REGISTRY_SQL} select doc_id, gtin, lookup_status, rb from lk", ("barcodes",))
def _(t):
    return _looked_up(t).select("doc_id", "gtin", "lookup_status", "rb")


def _compared(t):
    rows = _looked_up(t).withColumn("label_quantity", F.concat(F.col("p_size").cast("string"), F.lit(" G")))
    return J.identity_compare(rows, {"brand": ("p_brand", "rb"), "description": ("p_name", "rn"), "net_content": ("label_quantity", "rq")}, F.col("lookup_status") == "VERIFIED")


_STATES_SQL = f"""{_REGISTRY_SQL}, s1 as (select doc_id, gtin, lookup_status, case when lookup_status <> 'VERIFIED' then 'NOT_AVAILABLE' when regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g') = regexp_replace(lower(rb), '[^a-z0-9]+', ' ', 'g') then 'CONSISTENT' else 'MISMATCH' end as brand,
  case when lookup_status <> 'VERIFIED' then 'NOT_AVAILABLE' when p_name = rn then 'CONSISTENT' else 'MISMATCH' end as description, case when lookup_status <> 'VERIFIED' then 'NOT_AVAILABLE' when p_size || 'g' = rq then 'CONSISTENT' else 'MISMATCH' end as net_content from lk)"""


@query("j4_identity_compare", f"with {_STATES_SQL} select doc_id, 'brand=' || brand || ',description=' || description || ',net_content=' || net_content as states from s1", ("barcodes",))
def _(t):
    return _compared(t).select("doc_id", F.array_join(F.transform("states", lambda s: F.concat_ws("=", s["field"], s["state"])), ",").alias("states"))


@query("j4_identity_rollup", f"""with {_STATES_SQL} select doc_id % 100 as scan_id, case when bool_or('MISMATCH' in (brand, description, net_content)) then 'REVIEW_REQUIRED' when bool_or(lookup_status = 'VERIFIED') then 'EXTERNAL_VERIFIED_SUPPORTING' when bool_or(gtin is not null) then 'LOCAL_VALIDATION_ONLY' else 'IDENTIFIER_REVIEW_REQUIRED' end as status, count(*) as barcodes from s1 group by 1""", ("barcodes",))
def _(t):
    return J.identity_rollup(_compared(t).withColumn("scan_id", F.col("doc_id") % 100), "scan_id")


def _boxes(t):
    """Boxes of a primary and a second reading of each label."""
    d = t.view("detections").withColumnRenamed("doc_id", "image_id")
    k, n = F.col("image_id"), F.col("pos")
    shift = (k + n) % 5
    other = d.where((k + n) % 9 != 0).withColumn("text", F.when(k * n % 7 == 0, F.concat("text", F.lit(" ~"))).otherwise(F.upper("text")))
    for c in ("x1", "y1", "x2", "y2"):
        other = other.withColumn(c, F.col(c) + shift)
    return d, other.withColumn("confidence", F.when(n % 6 == 0, 0.0).otherwise(F.col("confidence")))


_BOX_SQL = """other as (select doc_id, pos, case when doc_id * pos % 7 = 0 then text || ' ~' else upper(text) end as text, case when pos % 6 = 0 then 0.0 else confidence end as confidence,
   x1 + (doc_id + pos) % 5 as x1, y1 + (doc_id + pos) % 5 as y1, x2 + (doc_id + pos) % 5 as x2, y2 + (doc_id + pos) % 5 as y2 from detections where (doc_id + pos) % 9 <> 0),
 g as (select a.doc_id, a.pos as l, b.pos as r, a.text as ta, b.text as tb, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) as ox, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as oy, a.x2 - a.x1 as aw, a.y2 - a.y1 as ah, b.x2 - b.x1 as bw, b.y2 - b.y1 as bh,
   abs((a.y1 + a.y2) / 2.0 - (b.y1 + b.y2) / 2.0) as cen, greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) as gap from detections a join other b on b.doc_id = a.doc_id where a.confidence > 0 or b.confidence > 0),
 s as (select *, (ox * oy)::double / (aw * ah + bw * bh - ox * oy) as iou, least(1, oy::double / least(ah, bh)) * least(1, ox::double / least(aw, bw)) as con from g),
 sc as (select *, case when con >= 0.5 then greatest(iou, 0.7 * con) else greatest(iou, case when cen <= 0.5 * greatest(ah, bh) and gap <= 0.5 * greatest(ah, bh) then 0.5 else 0.0 end) end as score from s)"""


@query("j5a_geometry_score", f"with {_BOX_SQL} select doc_id as image_id, l, r, round(score, 6) as score from sc where score >= 0.45", ("detections",))
def _(t):
    pairs = J.candidate_pairs(*_boxes(t))
    return pairs.select("image_id", F.col("a.pos").alias("l"), F.col("b.pos").alias("r"), F.round("score", 6).alias("score"))


@query("j5b_text_similarity", f"""with {_BOX_SQL} select doc_id as image_id, l, r, round(case when lower(ta) = lower(tb) then 1.0 else 1.0 - levenshtein(lower(ta), lower(tb))::double / greatest(length(ta), length(tb)) end, 6) as similarity from sc where score >= 0.45""", ("detections",))
def _(t):
    pairs = J.candidate_pairs(*_boxes(t))
    return pairs.select("image_id", F.col("a.pos").alias("l"), F.col("b.pos").alias("r"), F.round(J.text_similarity(F.col("a.text"), F.col("b.text")), 6).alias("similarity"))


_MATCH_SQL = _BOX_SQL + """,
 rounds(i, doc_id, l, r, score, taken) as (select 0, doc_id, l, r, score, false from sc where score >= 0.45
   union all select i + 1, doc_id, l, r, score, t from (select *, bool_or(t) over (partition by doc_id, l) as al, bool_or(t) over (partition by doc_id, r) as ar from (select i, doc_id, l, r, score,
     row_number() over (partition by doc_id, l order by score desc, r desc) = 1 and row_number() over (partition by doc_id, r order by score desc, l desc) = 1 as t from rounds where not taken)) where t or not (al or ar)),
 picked as (select doc_id, l, r, score from rounds where taken),
 ka as (select doc_id, pos as l, trim(text) as left_text, confidence as ac, x1 as ax1, y1 as ay1, x2 as ax2, y2 as ay2 from detections where x2 > x1 and y2 > y1), kb as (select doc_id, pos as r, trim(text) as right_text, confidence as bc, x1 as bx1, y1 as by1, x2 as bx2, y2 as by2 from other where x2 > x1 and y2 > y1),
 lefts as (select ka.*, p.r, p.score from ka left join picked p using (doc_id, l)),
 matched as (select coalesce(lefts.doc_id, kb.doc_id) as image_id, lefts.l as left_pos, kb.r as right_pos, case when lefts.l is null then 'other_only' when kb.r is null then 'single_source' when lower(left_text) = lower(right_text) then 'consensus' else 'disagreement' end as status,
   coalesce(left_text, right_text) as text, coalesce(ac, bc) as confidence, case when lefts.l is not null then right_text end as other_text, case when lefts.l is not null then bc end as other_confidence, round(g.iou, 6) as iou, round(lefts.score, 4) as score,
   case when left_text is null or right_text is null then null when lower(left_text) = lower(right_text) then 1.0 else round(1.0 - levenshtein(lower(left_text), lower(right_text))::double / greatest(length(left_text), length(right_text)), 4) end as text_similarity,
   """ + ", ".join(f"(case when left_text is null then b{c} when right_text is null then a{c} else round_even((a{c} * greatest(ac, 0.01) + b{c} * greatest(bc, 0.01)) / (greatest(ac, 0.01) + greatest(bc, 0.01)), 0) end)::int as {c}" for c in ("x1", "y1", "x2", "y2")) + """
   from lefts full join kb on kb.doc_id = lefts.doc_id and kb.r = lefts.r left join sc g on g.doc_id = lefts.doc_id and g.l = lefts.l and g.r = kb.r)"""


@query("j5_match_boxes", f"with recursive {_MATCH_SQL} select * exclude (x1, y1, x2, y2) from matched", ("detections",))
def _(t):
    return J.match_boxes(*_boxes(t)).drop("x1", "y1", "x2", "y2")


@query("j5c_box_fusion", f"with recursive {_MATCH_SQL} select image_id, left_pos, x1, y1, x2, y2 from matched where left_pos is not null and right_pos is not null", ("detections",))
def _(t):
    return J.match_boxes(*_boxes(t)).where("left_pos is not null and right_pos is not null").select("image_id", "left_pos", "x1", "y1", "x2", "y2")


@query("j5d_disagreements", f"""with recursive {_MATCH_SQL} select image_id, left_pos, right_pos, 'review_required' as status, case when left_pos is not null then text end as left_text, case when left_pos is not null then confidence end as left_confidence,
 coalesce(other_text, text) as right_text, coalesce(other_confidence, confidence) as right_confidence, score, text_similarity, x1, y1, x2, y2 from matched where status in ('disagreement', 'other_only')""", ("detections",))
def _(t):
    return J.disagreements(J.match_boxes(*_boxes(t)))


@query("a25_ensemble_summary", f"""with recursive {_MATCH_SQL}, m as (select * from matched where image_id % 23 <> 0 and image_id % 29 <> 0 union all select * replace (case when right_pos is null then status else 'other_only' end as status, null as left_pos) from matched where image_id % 23 = 0 and image_id % 29 <> 0 and right_pos is not null
   union all select * replace ('single_source' as status, null as right_pos) from matched where image_id % 29 = 0 and image_id % 23 <> 0 and left_pos is not null),
 sums as (select image_id, count(*) as regions, count(*) filter (where status in ('disagreement', 'other_only')) as disagreements, case when bool_or(left_pos is not null) and bool_or(right_pos is not null) then 'comparison_review_only' when bool_or(left_pos is not null) then 'primary_only' else 'secondary_only_review' end as mode from m group by 1)
 select p_partkey as image_id, coalesce(mode, 'no_data') as mode, coalesce(regions, 0) as regions, coalesce(disagreements, 0) as disagreements, case when disagreements > 0 then 'review_required' else 'ok' end as status from part left join sums on sums.image_id = p_partkey""", ("detections",))
def _(t):
    left, right = _boxes(t)
    matched = J.match_boxes(left.where("image_id % 23 <> 0"), right.where("image_id % 29 <> 0"))
    return J.ensemble_summary(matched, t.part.select(F.col("p_partkey").alias("image_id")))


_AS_OF = "date '2024-07-01'"
_LEGAL_SQL = f"""src as (select s_suppkey as source_id, ['verified','unresolved','blocked','partial'][s_suppkey % 4 + 1] as vs, case when s_suppkey % 5 = 0 then date '2025-01-01' end as f, case when s_suppkey % 6 = 0 then date '2023-01-01' end as u from supplier),
 prv as (select p_partkey as provision_id, p_partkey % 100 as source_id, 'rule' || p_partkey % 40 as rule, 'field' || p_partkey % 6 as field, p_partkey % 7 <> 0 as cur, case when p_partkey % 8 = 0 then date '2024-12-01' end as f, case when p_partkey % 9 = 0 then date '2024-01-01' end as u from part),
 live as (select p.* from prv p join src s using (source_id) where p.cur and coalesce(p.f, {_AS_OF}) <= {_AS_OF} and coalesce(p.u, {_AS_OF}) >= {_AS_OF} and s.vs not in ('unresolved', 'blocked') and coalesce(s.f, {_AS_OF}) <= {_AS_OF} and coalesce(s.u, {_AS_OF}) >= {_AS_OF}),
 fin as (select o_orderkey as finding_id, 'rule' || o_orderkey % 45 as rule_id, case when o_orderkey % 4 <> 0 then 'field' || o_orderkey % 8 end as field from orders),
 cnt as (select finding_id, rule_id, fin.field, count(provision_id) n, min(provision_id) fp from fin left join live on live.rule = rule_id and (fin.field is null or fin.field = live.field) group by 1, 2, 3),
 rsn as (select *, case when field = 'field1' then 'legal_source_blocked' when field = 'field2' then 'legal_source_unresolved' when n = 0 then 'not_in_verified_corpus' end as reason from cnt)"""


@query("j6_legal_basis", f"""with {_LEGAL_SQL} select finding_id, rule_id, field, case when reason is null then 'found' else 'not_available' end as status, reason, case when reason is null then n else 0 end as provisions, case when reason is null then fp end as first_provision from rsn""")
def _(t):
    d = lambda cond, day: F.when(cond, day).cast("date")
    s, k, o = F.col("s_suppkey"), F.col("p_partkey"), F.col("o_orderkey")
    names = F.array(*[F.lit(v) for v in ("verified", "unresolved", "blocked", "partial")])
    label = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    sources = t.supplier.select(s.alias("source_id"), F.get(names, (s % 4).cast("int")).alias("verification_status"),
                                d(s % 5 == 0, "2025-01-01").alias("effective_from"), d(s % 6 == 0, "2023-01-01").alias("effective_until"))
    provisions = t.part.select(k.alias("provision_id"), (k % 100).alias("source_id"), label("rule", k % 40).alias("linked_rule_id"), label("field", k % 6).alias("linked_field"),
                               (k % 7 != 0).alias("is_currently_effective"), d(k % 8 == 0, "2024-12-01").alias("effective_from"), d(k % 9 == 0, "2024-01-01").alias("effective_until"))
    findings = t.orders.select(o.alias("finding_id"), label("rule", o % 45).alias("rule_id"), F.when(o % 4 != 0, label("field", o % 8)).alias("field"))
    return J.legal_basis(findings, provisions, sources, F.lit("2024-07-01").cast("date"), ["field1"], ["field2"])


def _artifacts(t, *by: str):
    """Artifacts of a package with their digests. Short rows are dealt by ``by``, all that follows on these keys stays where it is."""
    line = F.concat_ws("|", F.col("package_key").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    keys = ("package_key", "artifact_id")
    rows = t.lineitem.select(F.col("l_orderkey").alias("package_key"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("artifact_id"), "l_linenumber", "l_returnflag")
    return rows.repartition(*(by or keys)).groupBy(*keys).agg(F.min(F.sha2(line, 256)).alias("sha256"))


_ART_SQL = "art as (select l_orderkey as package_key, l_linenumber * 100000 + l_partkey as artifact_id, min(sha256(l_orderkey || '|' || l_linenumber || '|' || l_returnflag)) as sha256 from lineitem group by 1, 2)"


@query("j12_tampered", f"with {_ART_SQL} select package_key, artifact_id, case when artifact_id % 50 = 0 then 'missing' else 'changed' end as change from art where artifact_id % 50 = 0 or artifact_id % 70 = 1")
def _(t):
    art = _artifacts(t)
    a = F.col("artifact_id")
    now = art.where(a % 50 != 0).withColumn("sha256", F.when(a % 70 == 1, F.lit("x")).otherwise(F.col("sha256")))
    return I.tampered(art, now, ["package_key", "artifact_id"])


_CAL_SQL = "cal as (select p_partkey // 4 as image_id, p_partkey % 4 as pos, 10.0::double + (p_partkey % 13) / 10.0::double as scale, 0.05::double + (p_partkey % 3) / 20.0::double as u from part)"


def _calibrations(t):
    k = F.col("p_partkey")
    return t.part.select(F.floor(k / 4).alias("image_id"), (k % 4).alias("pos"), (F.lit(10.0) + k % 13 / F.lit(10.0)).alias("scale"), (F.lit(0.05) + k % 3 / F.lit(20.0)).alias("uncertainty"))


@query("j16_agreement_pairs", f"with {_CAL_SQL} select a.image_id, a.pos as first_pos, b.pos as second_pos, round(abs(a.scale - b.scale), 6) as difference, round(3 * sqrt(a.u * a.u + b.u * b.u), 6) as allowed from cal a join cal b on a.image_id = b.image_id and a.pos < b.pos and abs(a.scale - b.scale) > 3 * sqrt(a.u * a.u + b.u * b.u)")
def _(t):
    return J.agreement_pairs(_calibrations(t)).withColumn("difference", F.round("difference", 6)).withColumn("allowed", F.round("allowed", 6))


@query("j16_calibration_agreement", f"""with {_CAL_SQL}, d as (select a.image_id, count(*) n from cal a join cal b on a.image_id = b.image_id and a.pos < b.pos and abs(a.scale - b.scale) > 3 * sqrt(a.u * a.u + b.u * b.u) group by 1)
 select c.image_id, case when c.k >= 2 and d.n is null then 'REFERENCES_AGREE_REVIEW_ONLY' else 'REVIEW_REQUIRED' end as status, coalesce(d.n, 0) as disagreements from (select image_id, count(*) k from cal group by 1) c left join d using (image_id)""")
def _(t):
    return J.calibration_agreement(_calibrations(t))


@query("j17_with_parent", f"with {_ART_SQL} select package_key, artifact_id, case when package_key % 5 <> 0 then 'pk' || package_key end as package_id from art")
def _(t):
    packages = t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("package_key"), F.concat(F.lit("pk"), F.col("o_orderkey").cast("string")).alias("package_id"))
    return J.with_parent(_artifacts(t), packages).select("package_key", "artifact_id", "package_id")


@query("j18_flatten_first_seen", "select l_orderkey as doc_id, l_returnflag as field, arg_min(l_quantity, l_linenumber * 10000000 + l_partkey + l_quantity / 1000) as value from lineitem group by 1, 2")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), F.col("l_quantity").alias("value"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey") + F.col("l_quantity") / 1000).alias("ord"))
    return J.flatten_first_seen(rows, ["doc_id", "field"], "ord").select("doc_id", "field", "value")


_ANCHOR_SQL = """anc as (select c_custkey as id, case c_custkey % 8 when 0 then lpad((c_custkey * 7919)::varchar, 14, '1') when 1 then '890' || lpad((c_custkey * 104729)::varchar, 10, '2') when 2 then lpad(c_custkey::varchar, 13, '4') when 3 then lpad(c_custkey::varchar, 12, '5')
  when 4 then 'R-' || lpad(c_custkey::varchar, 8, '6') when 5 then 'r-' || c_custkey % 1000 when 6 then 'R-' || lpad(c_custkey::varchar, 7, '7') else ' hello ' end as v from customer)"""
_DSUM = "list_sum(list_transform(range(1, {n}), lambda i: substr(v, i::int, 1)::int))::int"


@query("i3_classify_anchor", f"""with {_ANCHOR_SQL} select id, case id % 8 when 0 then 'fssai' when 1 then 'ean13' when 2 then 'fssai' when 3 then 'ean13' when 7 then 'unknown' else 'bis_registration' end as anchor_type,
 case id % 8 when 0 then case when substr(v, 14, 1)::int = (10 - {_DSUM.format(n=14)} % 10) % 10 then 'valid' else 'invalid' end
  when 1 then case when substr(v, 13, 1)::int = (10 - list_sum(list_transform(range(1, 13), lambda i: substr(v, i::int, 1)::int * case when i % 2 = 1 then 1 else 3 end))::int % 10) % 10 or substr(v, 13, 1)::int = ({_DSUM.format(n=13)} % 10 + 9) % 10 then 'valid' else 'invalid' end
  when 4 then 'valid' when 6 then 'invalid' else 'ambiguous' end as anchor_status from anc""")
def _(t):
    k = F.col("c_custkey")
    pad = lambda c, n, f: F.lpad(c.cast("string"), n, f)
    v = (F.when(k % 8 == 0, pad(k * 7919, 14, "1")).when(k % 8 == 1, F.concat(F.lit("890"), pad(k * 104729, 10, "2"))).when(k % 8 == 2, pad(k, 13, "4")).when(k % 8 == 3, pad(k, 12, "5"))
         .when(k % 8 == 4, F.concat(F.lit("R-"), pad(k, 8, "6"))).when(k % 8 == 5, F.concat(F.lit("r-"), (k % 1000).cast("string"))).when(k % 8 == 6, F.concat(F.lit("R-"), pad(k, 7, "7"))).otherwise(" hello "))
    return I.classify_anchors(t.customer.select(k.alias("id"), v.alias("v")), "v").select("id", "anchor_type", "anchor_status")


@query("i4_content_digest", """select page_id, sha256(j) as sha256, strlen(j)::int as size from (select page_id, '{"lang":' || case when page_id % 3 = 0 then 'null' else '"x' || page_id || '"' end || ',"page_id":' || page_id || ',"url":"' || url || '"}' as j from pages)""")
def _(t):
    rows = t.pages.select("page_id", "url", F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("x"), F.col("page_id").cast("string"))).alias("lang"))
    return I.content_digest(rows, ["page_id", "url", "lang"]).select("page_id", "sha256", "size")


def _audit_log(t):
    """One hash-linked chain per user; some links and contents are damaged."""
    from labelwright.operators.windows import chain_links
    linked = chain_links(t.events, "user_id", "ts", "event_id")
    e, p = F.col("event_id"), F.col("previous")
    content = lambda c: F.concat_ws("|", F.col("user_id").cast("string"), c.cast("string"))
    previous = F.when(e % 997 == 0, F.sha2(F.lit("nowhere"), 256)).when(e % 991 == 1, F.lit(None)).otherwise(F.when(p.isNotNull(), F.sha2(content(p), 256)))
    return linked.select(F.col("user_id").alias("chain_id"), "event_id", F.when(e % 499 == 2, F.concat(content(e), F.lit("!"))).otherwise(content(e)).alias("canonical"),
                         previous.alias("previous_hash"), F.sha2(content(e), 256).alias("event_hash"))


_CHAIN_SQL = """log as (select user_id as chain_id, event_id, case when event_id % 499 = 2 then user_id || '|' || event_id || '!' else user_id || '|' || event_id end as canonical,
  case when event_id % 997 = 0 then sha256('nowhere') when event_id % 991 = 1 then null else sha256(user_id || '|' || prev) end as previous_hash, sha256(user_id || '|' || event_id) as event_hash
  from (select *, lag(event_id) over (partition by user_id order by ts, event_id) as prev from events))"""


@query("i2_verify_chain", f"""with {_CHAIN_SQL} select chain_id, event_id, 'tampered' as finding from log where sha256(canonical) <> event_hash
 union all select chain_id, event_id, 'broken_link' from log l where previous_hash is not null and not exists (select 1 from log p where p.chain_id = l.chain_id and p.event_hash = l.previous_hash)
 union all select chain_id, max(event_id), 'fork' from log where previous_hash is not null group by chain_id, previous_hash having count(*) > 1
 union all select chain_id, max(event_id), 'several_roots' from log where previous_hash is null group by chain_id having count(*) > 1""")
def _(t):
    return I.verify_chain(_audit_log(t))


_LEVEL = "list_transform(range(0, (len({l}) + 1) // 2), lambda i: unhex(sha256({l}[2 * i + 1] || coalesce({l}[2 * i + 2], {l}[2 * i + 1]))))"


def _fold_sql(source: str, levels: int) -> str:
    """Unrolled levels of the tree over a list column ``l0`` of blobs."""
    inner = source
    for i in range(levels):
        inner = f"(select * exclude (l{i}), case when len(l{i}) > 1 then {_LEVEL.format(l=f'l{i}')} else l{i} end as l{i + 1} from {inner})"
    return inner


@query("a27_merkle_root", f"with {_ART_SQL}, lv as (select package_key, list(encode(sha256) order by artifact_id) as l0 from art group by 1) select package_key, lower(hex(l4[1])) as merkle_root from {_fold_sql('lv', 4)}")
def _(t):
    return I.merkle_root(_artifacts(t, "package_key"), "package_key", "artifact_id", "sha256")


def _packages(t):
    k = F.col("l_orderkey")
    return t.lineitem.select(k.alias("package_key")).distinct().select(
        "package_key", F.concat(F.lit("ev"), F.col("package_key").cast("string")).alias("evidence_id"), F.when(F.col("package_key") % 3 != 0, "abc").alias("ruleset_digest"),
        F.create_map(F.lit("ocr"), F.lit("d1")).alias("model_digests"))


_SEAL_SQL = f"""{_ART_SQL}, lv as (select package_key, list_prepend(encode(sha256('{{"evidence_id":"ev' || package_key || '","model_digests":{{"ocr":"d1"}},"package_version":"2.0.0","ruleset_digest":' || case when package_key % 3 <> 0 then '"abc"' else 'null' end || '}}')), list(encode(sha256) order by artifact_id)) as l0 from art group by 1),
 seal as (select package_key, lower(hex(l4[1])) as merkle_root from {_fold_sql('lv', 4)})"""


def _sealed_artifacts(t):
    return _artifacts(t, "package_key").withColumnRenamed("sha256", "artifact_digest")


def _sealed(t):
    return I.seal_packages(_packages(t), _sealed_artifacts(t))


@query("i5_seal_packages", f"with {_SEAL_SQL} select package_key, merkle_root, 'evidence-' || substr(sha256(merkle_root), 1, 16) as package_id from seal")
def _(t):
    return _sealed(t)


@query("i5_verify_packages", f"""with {_SEAL_SQL}, c as (select package_key, count(*) n from art where artifact_id % 70 = 1 group by 1)
 select s.package_key, coalesce(n, 0) as changed_artifacts, n is null and s.package_key % 11 <> 0 and s.package_key % 13 <> 0 as valid,
  concat_ws(',', case when n is not null then 'artifacts' end, case when s.package_key % 11 = 0 and n is null then 'package_manifest' end, case when s.package_key % 13 = 0 then 'package_id' end) as problems from seal s left join c using (package_key)""")
def _(t):
    k = F.col("package_key")
    art = _artifacts(t)
    stored = _sealed(t).withColumn("merkle_root", F.when(k % 11 == 0, F.lit("00")).otherwise(F.col("merkle_root"))).withColumn(
        "package_id", F.when(k % 13 == 0, F.lit("evidence-x")).otherwise(F.col("package_id")))
    now = art.withColumn("sha256", F.when(F.col("artifact_id") % 70 == 1, F.lit("x")).otherwise(F.col("sha256")))
    changes = I.tampered(art, now, ["package_key", "artifact_id"])
    return I.verify_packages(stored, _packages(t), _sealed_artifacts(t), changes)


@query("i6_replay_safe", """with r as (select event_id, user_id || ':' || event_type as k from events), f as (select k, min(event_id) f from r group by 1), s as (select user_id || ':' || event_type as k, min(event_id) - 1000000 as st from events where user_id % 10 = 0 group by 1)
 select k as record_key, event_id, coalesce(st, case when event_id > f then f end) is not null as duplicate, coalesce(st, case when event_id > f then f end) as first_record from r join f using (k) left join s using (k)""")
def _(t):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("record_key")
    existing = t.events.where("user_id % 10 = 0").select(key, (F.col("event_id") - 1000000).alias("event_id"))
    return I.replay_safe(t.events.select(key, "event_id"), existing, "record_key", "event_id")


@query("i7_submission_payload", """with b as (select page_id, case when page_id % 4 <> 0 then 'p' || page_id end as pid, case when page_id % 8 <> 0 then 'e' || page_id end as eid, case when page_id % 6 = 0 then 'zz' else upper(sha256(url)) end as root, case when page_id % 9 = 0 then 'bad' else sha256('b') end as hb from pages),
 c as (select *, case when hb = 'bad' then 'artifact_hash' when root = 'zz' then 'merkle_root' when pid is null and eid is null then 'identifier' end as problem from b),
 d as (select *, case when problem is null then sha256('{"artifact_hashes":{"a":"' || sha256('a') || '","b":"' || hb || '"},"evidence_id":' || coalesce('"' || eid || '"', 'null') || ',"evidence_package_id":' || coalesce('"' || pid || '"', 'null') || ',"merkle_root":"' || lower(root) || '","schema_version":1}') end as ps from c)
 select page_id as package_key, case when problem is null then 'ready' else 'validation_failure' end as status, problem, ps as payload_sha256, case when problem is null then sha256(coalesce(pid, eid) || ':' || ps) end as idempotency_key from d""")
def _(t):
    k = F.col("page_id")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    rows = t.pages.select(k.alias("package_key"), F.when(k % 4 != 0, name("p")).alias("package_id"), F.when(k % 8 != 0, name("e")).alias("evidence_id"),
                          F.when(k % 6 == 0, "zz").otherwise(F.upper(F.sha2("url", 256))).alias("merkle_root"),
                          F.create_map(F.lit("b"), F.when(k % 9 == 0, "bad").otherwise(F.sha2(F.lit("b"), 256)), F.lit("a"), F.sha2(F.lit("a"), 256)).alias("artifact_hashes"))
    return I.submission_payload(rows)


@query("i8_signoff_check", f"""with {_SEAL_SQL} select package_key as signoff_id, 'p' || package_key as package_id, case when package_key % 7 = 0 then 'reviewer' when package_key % 9 = 0 then 'root' when package_key % 5 = 0 then 'root_mismatch' when package_key % 11 = 0 then 'decision' end as problem,
 not (package_key % 7 = 0 or package_key % 9 = 0 or package_key % 5 = 0 or package_key % 11 = 0) as accepted from seal""")
def _(t):
    k = F.col("package_key")
    stored = _sealed(t).select("package_key", F.concat(F.lit("p"), k.cast("string")).alias("package_id"), "merkle_root")
    signoffs = stored.select(k.alias("signoff_id"), "package_id", F.when(k % 7 != 0, "r1").alias("reviewer_id"),
                             F.when(k % 9 == 0, "").when(k % 5 == 0, "other").otherwise(F.col("merkle_root")).alias("merkle_root"), F.when(k % 11 != 0, "APPROVED").otherwise("").alias("decision"))
    return I.signoff_check(signoffs, stored)


@query("s11_insert_if_absent", "select event_type || user_id as k, min(event_id) as event_id from events where user_id % 3 <> 0 group by 1")
def _(t):
    new = t.events.select(F.concat("event_type", F.col("user_id").cast("string")).alias("k"), "event_id")
    target = t.events.where("user_id % 3 = 0").select(F.concat("event_type", F.col("user_id").cast("string")).alias("k"))
    return I.insert_if_absent(new, target, "k")[0]


@query("s11_rejected", """select k, case when u % 3 = 0 then n else n - 1 end as rejected, case when u % 3 = 0 then 'exists' else 'repeated' end as reason from (select event_type || user_id as k, min(user_id) u, count(*) n from events group by 1) where u % 3 = 0 or n > 1""")
def _(t):
    new = t.events.select(F.concat("event_type", F.col("user_id").cast("string")).alias("k"), "event_id")
    target = t.events.where("user_id % 3 = 0").select(F.concat("event_type", F.col("user_id").cast("string")).alias("k"))
    return I.insert_if_absent(new, target, "k")[1]
