"""Queries of evidence linking, overlays, the field table and geometry (survey T29 to T39, C8 to C11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.operators import evidence as E
from labelwright.operators import geometry as G
from labelwright.operators import lines as L
from labelwright.plans.queries_lines import _PRICE_SQL, q
from labelwright.plans.registry import query

_VALUE_FIELDS = ("net_quantity", "country_of_origin", "unit_sale_price", "month_and_year_of_manufacture_or_packing")


def cited_values() -> Column:
    lines = L.line_col()
    price = L.append_supporting(L.price_line(lines), lines, P.TAX_WORDING)
    rows = [("maximum_retail_price_mrp", price)] + [(f, F.get(lines, L.keyword_index(f))) for f in _VALUE_FIELDS]
    return F.filter(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in rows]),
                    lambda r: r["value"].isNotNull())


def tok(col: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all(lower({col}), '[a-z0-9]+'), ' ') || ' '"


_ALONE = ", ".join(f"' {w} '" for w in P.EVIDENCE_SINGLE_LABELS)
_FIELD_LIST = ", ".join(f"'{f}'" for f in _VALUE_FIELDS)
EVIDENCE_SQL = f"""{_PRICE_SQL}, vals as materialized (select doc_id, 'maximum_retail_price_mrp' as field, value from price
  union all select doc_id, field, text from kw where field in ({_FIELD_LIST})),
 dt as materialized (select *, {tok('text')} as tok, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as nt from detections),
 ev as materialized (select v.doc_id, v.field, v.value, d.pos, d.confidence from (select *, {tok('value')} as needle from vals) v join dt d on d.doc_id = v.doc_id
  where length(tok) > 2 and length(needle) > 2 and (contains(needle, tok) or contains(tok, needle)) and (tok = needle or nt > 1 or tok in ({_ALONE})))"""


@query("t29_evidence_match", f"with {EVIDENCE_SQL} select doc_id, field, pos, confidence from ev", ("keywords", "detections"))
def _(t):
    return E.evidence_match(t.label_docs.withColumn("_v", cited_values()), F.col("_v"))


@query("t30_field_evidence", f"""with {EVIDENCE_SQL}, page as (select doc_id, avg(confidence) pc from detections group by doc_id),
 ag as (select doc_id, field, avg(confidence) c, string_agg('region_' || pos, ',' order by pos) ids from ev group by 1, 2)
 select v.doc_id, v.field, v.value, round(coalesce(round(c, 4), pc), 6) as confidence, coalesce(ids, '') as region_ids from vals v left join ag using (doc_id, field) join page p using (doc_id)""",
       ("keywords", "detections"))
def _(t):
    found = E.field_evidence(t.label_docs.withColumn("_v", cited_values()), F.col("_v"))
    return found.select("doc_id", "field", "value", F.round("confidence", 6).alias("confidence"),
                        F.array_join("region_ids", ",").alias("region_ids"))


_CLASS_FIELDS = ", ".join(f"('{c}', {i}, '{f}')" for i, (c, fs) in enumerate(P.REGION_CLASS_FIELDS.items()) for f in fs)


_BEST_SQL = """best as (select doc_id, class_name, nullif(trim(full_text), '') as full_text, confidence from (select *, row_number() over (partition by doc_id, class_name
   order by detection_confidence desc, pos) rn from regions) where rn = 1)"""


@query("t31_overlay_regions", f"""with {_BEST_SQL},
 ov as (select doc_id, m.field, full_text as v, confidence as c, case when class_name = 'consumer_care' then full_text end as care, '{P.REGION_ID_PREFIX}' || class_name as id
  from best b join (values {_CLASS_FIELDS}) m(class_name, i, field) using (class_name)),
 j as (select coalesce(b.doc_id, ov.doc_id) as doc_id, coalesce(b.field, ov.field) as field, c is not null as over, case when c is not null then v else b.value end as value,
  case when c is not null then c else b.confidence end as confidence, care, id from base_fields b full outer join ov on ov.doc_id = b.doc_id and ov.field = b.field)
 select doc_id, field, value, value is not null as detected, confidence, case when over and value is not null then id else '' end as region_ids, care as care_address,
  nullif(regexp_extract(care, {q(P.PHONE)}), '') as care_telephone_number, nullif(regexp_extract(care, {q(P.EMAIL)}), '') as care_email_address,
  case when over then 'region' else 'page' end as source from j""", ("base_fields", "regions"))
def _(t):
    return E.overlay_regions(t.view("base_fields"), t.view("regions")).withColumn("region_ids", F.array_join("region_ids", ","))


@query("t31_region_metadata", f"""with {_BEST_SQL}, md as (select doc_id, nullif(regexp_extract(full_text, {q(P.REGION_BATCH)}, 1), '') as batch_lot_number,
  nullif(trim(regexp_extract(full_text, {q(P.REGION_EXPIRY)}, 1)), '') as expiry_or_best_before_date from best where class_name = 'mfg_date_batch')
 select * from md where batch_lot_number is not null or expiry_or_best_before_date is not null""", ("regions",))
def _(t):
    return E.region_metadata(t.view("regions"))


@query("t32_overlay_supplied", """with sup as (select p_partkey as doc_id, case when p_partkey % 2 = 0 then 'net_quantity' else 'supplier_note' end as field, 'given ' || p_name as value,
   case when p_partkey % 3 = 0 then 0.99 end as c from part where p_partkey % 5 = 0),
 page as (select doc_id, avg(confidence) pc from detections group by doc_id)
 select coalesce(b.doc_id, s.doc_id) as doc_id, coalesce(b.field, s.field) as field, coalesce(s.value, b.value) as value,
  round(case when s.value is not null then coalesce(s.c, pc) else b.confidence end, 6) as confidence
 from base_fields b full outer join sup s on s.doc_id = b.doc_id and s.field = b.field left join page on page.doc_id = s.doc_id""", ("base_fields", "detections"))
def _(t):
    k = F.col("p_partkey")
    supplied = t.part.where(k % 5 == 0).select(
        k.alias("doc_id"), F.when(k % 2 == 0, "net_quantity").otherwise("supplier_note").alias("field"),
        F.concat(F.lit("given "), F.col("p_name")).alias("value"), F.when(k % 3 == 0, 0.99).alias("confidence"))
    page = L.page_confidence(t.label_docs).select("doc_id", "page_confidence")
    return E.overlay_supplied(t.view("base_fields"), supplied, page).withColumn("confidence", F.round("confidence", 6))


@query("t33_overlay_suggestions", f"""with sg as (select p_partkey as doc_id, ['product_identity','mrp','net_quantity','colour'][p_partkey % 4 + 1] as class_name,
   case when p_partkey % 8 = 1 then 'M.R.P. 10' else p_name end as value, (p_partkey % 10) / 10.0::double as c from part where p_partkey % 3 = 0),
 pr as (select doc_id, m.field, case when class_name = 'mrp' and not regexp_matches(value, {q(P.PRICE_LABEL)}) then 'MRP ' || value else value end as v, c
  from sg join (values {_CLASS_FIELDS}) m(class_name, i, field) using (class_name))
 select coalesce(b.doc_id, pr.doc_id) as doc_id, coalesce(b.field, pr.field) as field, case when c is not null then v else value end as value,
  case when c is not null then c else confidence end as confidence, case when c is not null then 'suggested' else 'page' end as source
 from base_fields b full outer join pr on pr.doc_id = b.doc_id and pr.field = b.field""", ("base_fields",))
def _(t):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(c) for c in ("product_identity", "mrp", "net_quantity", "colour")])
    suggestions = t.part.where(k % 3 == 0).select(
        k.alias("doc_id"), F.get(names, (k % 4).cast("int")).alias("class_name"),
        F.when(k % 8 == 1, "M.R.P. 10").otherwise(F.col("p_name")).alias("value"), (k % 10 / F.lit(10.0)).alias("confidence"))
    return E.overlay_suggestions(t.view("base_fields"), suggestions)


_FIRST_FIELDS = ", ".join(f"('{c}', {i}, '{fs[0]}')" for i, (c, fs) in enumerate(P.REGION_CLASS_FIELDS.items()))


@query("t34_ambiguous_fields", f"""select doc_id, cast(rn as int) as ord, class_name from (
 select p.p_partkey as doc_id, m.class_name, row_number() over (partition by p.p_partkey order by m.i) rn from part p cross join (values {_FIRST_FIELDS}) m(class_name, i, field)
 left join base_fields b on b.doc_id = p.p_partkey and b.field = m.field where coalesce(b.confidence, 0) < 0.8) where rn <= 4""", ("base_fields",))
def _(t):
    return E.ambiguous_fields(t.label_docs, t.view("base_fields"))


@query("field_table")
def _(t):
    return E.extract_fields(t.label_docs).withColumn("region_ids", F.array_join("region_ids", ","))


@query("t35_structured_extraction")
def _(t):
    return E.structured_extraction(t.label_docs)


@query("t35_overall_confidence")
def _(t):
    return E.overall_confidence(E.structured_extraction(t.label_docs))


@query("t36_words_to_lines", """select doc_id, block, par, line, string_agg(text, ' ' order by word) as text, round(avg(least(conf, 100)) / 100, 6) as confidence,
 min(left_) as x1, min(top) as y1, max(left_ + width) as x2, max(top + height) as y2 from words where conf >= 0 and length(trim(text)) > 0 group by 1, 2, 3, 4""", ("words",))
def _(t):
    return E.words_to_lines(t.view("words")).withColumn("confidence", F.round("confidence", 6))


@query("t37_pixel_geometry", """select doc_id, pos, case when s is not null then 'experimental_measurement' else 'review_required' end as status,
 round((x2 - x1) / s, 4) as width, round((y2 - y1) / s, 4) as height, round(0.5 / s, 4) as bound, case when s is null then 'validated_physical_calibration_unavailable' end as reason
 from (select *, case when doc_id % 3 <> 1 then (8 + doc_id % 4)::double * 10 end as s from detections)""", ("detections",))
def _(t):
    d = t.view("detections").withColumn("scale_px_per_mm", F.when(F.col("doc_id") % 3 != 1, (8 + F.col("doc_id") % 4).cast("double")))
    return G.pixel_geometry(d.withColumn("uncertainty_px", F.lit(0.5)), "cm")


@query("t38_legibility", """select doc_id, pos, 'review_required' as status, case when hp > 0 and sc > 0 then round(hp / sc, 4) end as height_mm,
 case when hp <= 0 then 'height' when sc is null then 'scale' when doc_id % 7 = 0 then 'coverage' when mm is null then 'no_threshold' else 'review' end as reason,
 case when hp > 0 and sc is not null and doc_id % 7 <> 0 then case when mm is null then 'unavailable' when doc_id % 2 = 0 then 'verified_review_only' else 'unverified' end end as threshold_status,
 case when hp > 0 and sc is not null and doc_id % 7 <> 0 and mm is not null and doc_id % 2 = 0 then case when hp / sc >= mm then 'at_or_above' else 'below' end end as comparison
 from (select doc_id, pos, case when pos % 6 = 5 then 0.0 else (y2 - y1)::double end as hp, case when doc_id % 3 <> 1 then (8 + doc_id % 4)::double end as sc, case when pos % 4 <> 0 then 2.5 end as mm from detections)""", ("detections",))
def _(t):
    k, pos = F.col("doc_id"), F.col("pos")
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    quad = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    d = t.view("detections").select(
        "doc_id", "pos", F.when(pos % 6 == 5, 0.0).otherwise(G.text_height(quad)).alias("height_px"),
        F.when(k % 3 != 1, (8 + k % 4).cast("double")).alias("scale_px_per_mm"), F.when(pos % 4 != 0, 2.5).alias("minimum_mm"),
        (k % 2 == 0).alias("threshold_verified"), (k % 7 != 0).alias("coverage_ok"))
    return G.legibility(d)


_PADDED = """greatest(0, x1 - floor((x2 - x1) * 0.05)::int) as x1, greatest(0, y1 - floor((y2 - y1) * 0.05)::int) as y1,
 least(frame_w, x2 + floor((x2 - x1) * 0.05)::int) as x2, least(frame_h, y2 + floor((y2 - y1) * 0.05)::int) as y2"""


@query("t39_best_crop", f"""with b as (select *, row_number() over (partition by doc_id order by greatest(0, x2 - x1) * greatest(0, y2 - y1) desc, pos) rn from panel_boxes)
 select * from (select doc_id, {_PADDED} from b where rn = 1 and (x2 - x1) * (y2 - y1) >= 0.10 * frame_w * frame_h) where x2 > x1 and y2 > y1""", ("panel_boxes",))
def _(t):
    return G.best_crop(t.view("panel_boxes"))


@query("t39_all_crops", f"select * from (select doc_id, pos, {_PADDED} from panel_boxes) where x2 > x1 and y2 > y1", ("panel_boxes",))
def _(t):
    return G.all_crops(t.view("panel_boxes"))


@query("c8_scale_from_reference", """with ref as (select n_nationkey as rid, a.axis, case a.axis when 'width' then 85.6 else 53.98 end + n_nationkey as mm, 0.1 as u from nation, (values ('width'), ('height')) a(axis)),
 obs as (select p_partkey as obs_id, p_partkey % 25 as rid, r.axis, r.mm * (10 + p_partkey % 7) * case when r.axis = 'height' and p_partkey % 11 = 0 then 1.1 else 1.0 end as px from part join ref r on r.rid = p_partkey % 25
   where not (r.axis = 'height' and p_partkey % 13 = 0)),
 s as (select p.p_partkey as obs_id, r.rid, px / mm as s, px / mm * sqrt(pow(1.0 / px, 2) + pow(u / mm, 2)) as us from part p join ref r on r.rid = p.p_partkey % 25 left join obs o on o.obs_id = p.p_partkey and o.axis = r.axis),
 g as (select obs_id, rid, count(*) n, count(s) ok, avg(s) m, sqrt(sum(us * us)) root, max(s - us) > min(s + us) as bad from s group by 1, 2)
 select obs_id, rid as reference_id, case when ok < n or bad then 'REVIEW_REQUIRED' else 'CALIBRATED_REVIEW_ONLY' end as status, case when ok < n then 'axis_unavailable' when bad then 'axes_disagree' end as reason,
  case when ok = n and not bad then round(m, 8) end as scale_px_per_mm, case when ok = n and not bad then round(root / n, 8) end as uncertainty_px_per_mm from g""")
def _(t):
    axes = F.explode(F.array(F.lit("width"), F.lit("height"))).alias("axis")
    references = t.nation.select(F.col("n_nationkey").cast("bigint").alias("reference_id"), axes).withColumn(
        "mm", F.when(F.col("axis") == "width", 85.6).otherwise(53.98) + F.col("reference_id")).withColumn("uncertainty_mm", F.lit(0.1))
    k = F.col("p_partkey")
    seen = t.part.select(k.alias("obs_id"), (k % 25).alias("reference_id")).join(F.broadcast(references), "reference_id")
    tilt = F.when((F.col("axis") == "height") & (F.col("obs_id") % 11 == 0), 1.1).otherwise(1.0)
    observations = seen.where(~((F.col("axis") == "height") & (F.col("obs_id") % 13 == 0))).select(
        "obs_id", "reference_id", "axis", (F.col("mm") * (10 + F.col("obs_id") % 7) * tilt).alias("px"), F.lit(1.0).alias("px_err"))
    return G.scale_from_reference(observations, references)


@query("c9_scale_from_quad", """with b as (select p_partkey as code_id, (300 + p_partkey % 100)::double as w, (p_partkey % 5 * 20)::double as sk, case when p_partkey % 13 = 0 then 200.0 else 640.0 end as fw,
   case when p_partkey % 9 <> 0 then 37.29 end as mm from part),
 e as (select *, sqrt(w * w + sk * sk) as e0, 100 - sk as e1, w as e2, 100.0 as e3 from b),
 d as (select *, greatest(abs(e0 - e2) / greatest(e0, e2), abs(e1 - e3) / greatest(e1, e3)) as dis from e),
 r as (select *, case when mm is null then 'reference' when 10 + w > fw then 'outside' when dis > 0.30 then 'distorted' end as reason from d)
 select code_id, case when reason is null then 'calibrated' else 'review_required' end as status, reason, case when reason is null then round(greatest((e0 + e2) / 2, (e1 + e3) / 2) / mm, 6) end as scale_px_per_mm,
  case when reason is null then round(dis, 4) end as distortion from r""")
def _(t):
    return G.scale_from_quad(t.view("quads"))


@query("c10_panel_coverage", """with e as (select distinct doc_id, x from (select doc_id, x1 as x from panel_boxes union all select doc_id, x2 from panel_boxes)),
 s as (select doc_id, x as a, lead(x) over (partition by doc_id order by x) as b from e),
 c as (select s.doc_id, s.a, s.b, p.y1, p.y2, max(p.y2) over (partition by s.doc_id, s.a order by p.y1, p.y2 rows between unbounded preceding and 1 preceding) as reach
  from s join panel_boxes p on p.doc_id = s.doc_id and p.x1 <= s.a and p.x2 >= s.b where s.b is not null),
 ar as (select doc_id, sum((b - a) * greatest(0, y2 - greatest(coalesce(reach, 0), y1))) as area from c group by doc_id),
 f as (select doc_id, max(frame_w) fw, max(frame_h) fh, bool_or(x2 > frame_w or y2 > frame_h) bad from panel_boxes group by doc_id)
 select f.doc_id, case when not bad then round(area / (fw * fh), 4) end as coverage, case when not bad and area / (fw * fh) >= 0.30 then 'eligible' else 'review_required' end as status from f left join ar using (doc_id)""", ("panel_boxes",))
def _(t):
    return G.panel_coverage(t.view("panel_boxes"))


@query("c11_reference_scale", """select p_partkey as code_id, case when p_partkey % 10 = 0 then 'rejected' else 'measured' end as status, case when p_partkey % 10 <> 0 then round(px / 37.29, 6) end as scale_px_per_mm,
 case when p_partkey % 10 <> 0 then round((20 + p_partkey % 30) * 37.29 / px, 4) end as height_mm, case when p_partkey % 10 <> 0 then round(abs(p_partkey % 7 * 10) / px, 4) end as distortion,
 case when p_partkey % 10 <> 0 then abs(p_partkey % 7 * 10) / px <= 0.30 end as acceptable from (select p_partkey, case when p_partkey % 10 = 0 then 0.0 else 150.0 + p_partkey % 100 end as px from part)""")
def _(t):
    k = F.col("p_partkey")
    px = F.when(k % 10 == 0, 0.0).otherwise((150 + k % 100).cast("double"))
    m = t.part.select(k.alias("code_id"), (20 + k % 30).cast("double").alias("feature_px"), px.alias("reference_px"), F.lit(37.29).alias("reference_mm"),
                      (px + k % 7 * 10).alias("observed_px"))
    return G.reference_scale(m)
