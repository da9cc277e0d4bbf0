"""Queries of filters, list shaping, windows and set operations (survey P and W, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.operators import filters as P
from labelwright.operators import windows as W
from labelwright.plans.registry import query

REV = ("revisions",)


@query("p1_public_view", """select revision_id::varchar as revision_id, product_id, review_status, score, case when image_key is not null then '/revisions/' || revision_id || '/image' end as image_url,
 case when revision_id % 3 = 0 then revision_id * 2 || ',' || (revision_id * 2 + 1) else '' end as official_ids from revisions""", REV)
def _(t):
    k = F.col("revision_id")
    entry = lambda c, action: F.struct(c.alias("official_id"), F.lit(action).alias("action"))
    both = F.array(entry(k * 2, "REJECTED"), entry(k * 2 + 1, "APPROVED"))
    rows = t.view("revisions").withColumn("history", F.when(k % 3 == 0, both).otherwise(F.slice(both, 1, 0)))
    out = P.public_view(rows, ["manufacturer_id", "priority", "created_at", "image_key"], ["revision_id"], "image_key", decisions="history")
    return out.withColumn("official_ids", F.array_join(F.transform("history", lambda d: d["official_id"]), ",")).drop("history")


@query("p2_owned_by", "select revision_id, product_id from revisions where product_id = 42", REV)
def _(t):
    return P.owned_by(t.view("revisions"), 42, "product_id").select("revision_id", "product_id")


@query("p3_submitted", "select revision_id, review_status from revisions where review_status is not null", REV)
def _(t):
    return P.submitted(t.view("revisions")).select("revision_id", "review_status")


@query("p3_open_queue", "select revision_id, review_status from revisions where review_status in ('PENDING_OFFICIAL_REVIEW', 'UNDER_OFFICIAL_REVIEW')", REV)
def _(t):
    return P.in_queue(t.view("revisions")).select("revision_id", "review_status")


@query("p4_search", "select p_partkey, p_name, p_brand from part where contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#1') and p_type = 'ECONOMY'")
def _(t):
    return P.search(t.part, ["p_name", "p_brand", "p_type"], "RING Brand#1", p_type="ECONOMY").select("p_partkey", "p_name", "p_brand")


@query("p5_map_status", """select bucket, count(*) as n from (select case o_orderkey % 6 when 0 then 'compliant' when 1 then 'flagged' when 2 then 'partial' when 4 then 'not_applicable' else 'manual_review' end as bucket from orders) group by 1""")
def _(t):
    names = F.array(*[F.lit(s) for s in ("PASS", "NON_COMPLIANT", "PARTIALLY_COMPLIANT", "REVIEW_REQUIRED", "NOT_APPLICABLE", "???")])
    scans = t.orders.select(F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("status"))
    return P.map_status(scans).groupBy("bucket").agg(F.count("*").alias("n"))


@query("p6_select_profile", """select profile, is_wholesale, count(*) as n from (select case when c in ('weighing_instrument','instrument','pos hardware') then 'pos_hardware_audit' when c in ('wholesale','wholesale_package','wholesale package') then 'wholesale_package'
  else 'e_commerce_product_listing' end as profile, c in ('wholesale','wholesale_package','wholesale package') as is_wholesale from (select lower(trim(case p_partkey % 4 when 0 then ' Instrument' when 1 then 'WHOLESALE package ' else p_type end)) as c from part)) group by 1, 2""")
def _(t):
    k = F.col("p_partkey")
    parts = t.part.select(F.when(k % 4 == 0, " Instrument").when(k % 4 == 1, "WHOLESALE package ").otherwise(F.col("p_type")).alias("category"))
    return P.select_profile(parts).groupBy("profile", "is_wholesale").agg(F.count("*").alias("n"))


@query("p7_clean_detections", """select doc_id, pos, trim(text) as text, round(least(1, greatest(0, confidence * 1.2 - 0.1)), 6) as confidence from detections where not (doc_id % 6 = 0 and pos % 4 = 0) and pos % 7 <> 3""", ("detections",))
def _(t):
    d = t.view("detections").withColumn("x2", F.when((F.col("doc_id") % 6 == 0) & (F.col("pos") % 4 == 0), F.col("x1")).otherwise(F.col("x2")))
    d = d.withColumn("confidence", F.when(F.col("pos") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("confidence") * 1.2 - 0.1))
    return P.clean_detections(d).select("doc_id", "pos", "text", F.round("confidence", 6).alias("confidence"))


@query("p8_reports_or_scan", """select o.o_orderkey as scan_id, l.l_linenumber as report_id, coalesce(l.l_returnflag, o.o_orderstatus) as status, coalesce(l.l_quantity, o.o_totalprice) as score
 from orders o left join lineitem l on l.l_orderkey = o.o_orderkey""")
def _(t):
    reports = t.lineitem.select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("report_id"),
                                F.col("l_returnflag").alias("status"), F.col("l_quantity").alias("score"))
    scans = t.orders.select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"))
    return P.reports_or_scan(scans, reports)


@query("p9_quality_gate", "select gate, count(*) as n from (select case when pos % 5 = 0 then 'missing' when confidence < 0.8 then 'low_confidence' else 'ok' end as gate from detections) group by 1", ("detections",))
def _(t):
    d = t.view("detections").withColumn("confidence", F.when(F.col("pos") % 5 != 0, F.col("confidence")))
    return P.quality_gate(d).groupBy("gate").agg(F.count("*").alias("n"))


@query("p10_text_visibility", """select p_partkey as doc_id, case when p_partkey % 8 = 0 then 'unavailable' when n > 0 then 'regions_detected' else 'not_detected_review_required' end as status,
 case when p_partkey % 8 = 0 then 0 else coalesce(n, 0) end as region_count from part left join (select doc_id, count(*) n from detections where doc_id % 5 <> 0 group by 1) d on d.doc_id = p_partkey""", ("detections",))
def _(t):
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 8 != 0).alias("success"))
    return P.text_visibility(docs, t.view("detections").where("doc_id % 5 <> 0"))


@query("p11_profile_applicability", """select applicability, count(*) as n from (select case when p_partkey % 9 = 0 or (p_partkey % 2 = 0 and p_partkey % 3 <> 0) then 'NOT_APPLICABLE' else 'APPLICABLE' end as applicability from part) group by 1""")
def _(t):
    k = F.col("p_partkey")
    rows = t.part.select(F.when(k % 2 == 0, "wholesale_declarations").otherwise("mandatory_declarations").alias("rule_id"),
                         F.when(k % 9 == 0, "unrelated").otherwise("packaged_commodity").alias("product_type"),
                         F.when(k % 3 == 0, "wholesale").otherwise("retail").alias("package_type"))
    return P.profile_applicability(rows).groupBy("applicability").agg(F.count("*").alias("n"))


@query("p12_enforce_registration", """with b as (select s_suppkey as k, ['STANDARD_REFERENCE','VERIFIED_REFERENCE','USER_ASSERTED_REFERENCE','OTHER'][s_suppkey % 4 + 1] as ty, ['height,width','diameter','side'][s_suppkey % 3 + 1] as ex,
   s_suppkey % 3 = 2 as ar from supplier),
 a as (select *, case when k % 5 = 0 then '' when k % 7 = 0 then 'diameter' else ex end as nom, case when k % 2 = 1 then ex else '' end as mea, case when k % 6 = 0 then '' else ex end as un from b),
 v as (select *, concat_ws(',', case when ty = 'OTHER' then 'type' end, case when ty = 'STANDARD_REFERENCE' and (nom = '' or k % 8 = 0) then 'provenance' end,
   case when ty = 'STANDARD_REFERENCE' and k % 9 = 0 then 'source_unconfirmed' end, case when ty = 'STANDARD_REFERENCE' and nom <> ex then 'axes' end,
   case when ty = 'STANDARD_REFERENCE' and nom <> un then 'uncertainty_axes' end, case when ty = 'VERIFIED_REFERENCE' and (mea = '' or un = '' or k % 8 = 0) then 'provenance' end,
   case when ty = 'VERIFIED_REFERENCE' and mea <> un then 'uncertainty_axes' end,
   case when ty <> 'STANDARD_REFERENCE' and (case when mea <> '' then mea else nom end) not in ('', ex) then 'axes' end, case when ar and k % 10 = 0 then 'marker' end) as vi from a)
 select k as reference_id, vi as violations, case when vi = '' then case when k % 11 = 0 then 'EXPIRED' when ty = 'VERIFIED_REFERENCE' then 'VERIFIED' else 'REGISTERED' end end as status,
  vi = '' and k % 11 <> 0 and ty in ('STANDARD_REFERENCE', 'VERIFIED_REFERENCE') and (nom <> '' or mea <> '') as eligible from v""")
def _(t):
    k = F.col("s_suppkey")
    pick = lambda names, m: F.get(F.array(*[F.lit(n) for n in names]), (k % m).cast("int"))
    maps = [F.create_map(F.lit("width"), F.lit(10.0), F.lit("height"), F.lit(20.0)), F.create_map(F.lit("diameter"), F.lit(5.0)), F.create_map(F.lit("side"), F.lit(7.0))]
    own, empty = F.get(F.array(*maps), (k % 3).cast("int")), F.expr("cast(map() as map<string,double>)")
    refs = t.supplier.select(
        k.alias("reference_id"), pick(["STANDARD_REFERENCE", "VERIFIED_REFERENCE", "USER_ASSERTED_REFERENCE", "OTHER"], 4).alias("reference_type"),
        pick(["rectangle", "circle", "aruco_square"], 3).alias("geometry_kind"),
        F.when(k % 5 == 0, empty).when(k % 7 == 0, maps[1]).otherwise(own).alias("nominal"), F.when(k % 2 == 1, own).otherwise(empty).alias("measured"),
        F.when(k % 6 == 0, empty).otherwise(own).alias("uncertainty"), (k % 8 != 0).alias("provenance_ok"), (k % 9 != 0).alias("source_verified"),
        F.when(k % 10 != 0, k).alias("marker_id"), F.when(k % 11 == 0, "2020-01-01").otherwise("2030-01-01").cast("date").alias("valid_until"))
    out = P.enforce_registration(refs, F.lit("2026-06-30").cast("date"))
    return out.select("reference_id", F.array_join("violations", ",").alias("violations"), "status", "eligible")


_URLS = {0: ("http://127.0.0.1/x", "ssrf_blocked", "127.0.0.1"), 1: ("ftp://files.example.com/a", "unsupported_scheme", "files.example.com"), 2: ("http://user:pw@shop.example.com/", "invalid_url", "shop.example.com"),
         3: ("http://LOCALHOST:80/", "ssrf_blocked", "localhost"), 4: ("http://192.168.1.7/", "ssrf_blocked", "192.168.1.7"), 5: ("https://8.8.8.8/q", "public", "8.8.8.8"),
         10: ("http://[fc00::1]/", "ssrf_blocked", "[fc00::1]"), 11: ("http://[FE80::1]:8080/x", "ssrf_blocked", "[fe80::1]"), 12: ("http://[::ffff:127.0.0.1]/", "ssrf_blocked", "[::ffff:127.0.0.1]"),
         13: ("https://[2606:4700::1111]/", "public", "[2606:4700::1111]"), 14: ("http://shop.example.com:99999/", "invalid_url", "shop.example.com"), 15: ("http://[2002:7f00:1::]/", "ssrf_blocked", "[2002:7f00:1::]"),
         16: ("http://[::ffff:8.8.8.8]/", "ssrf_blocked", "[::ffff:8.8.8.8]"), 17: ("http://[1::2::3]/", "invalid_url", "[1::2::3]"), 18: ("http://192.0.0.9:/", "public", "192.0.0.9")}


@query("p13_url_audit", f"""with known(r, url_class, host) as (values {", ".join(f"({k}, '{c}', '{h}')" for k, (_, c, h) in _URLS.items())}),
 c as (select coalesce(known.host, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^@/?#]*@)?([^:/?#]*)', 1))) as host, coalesce(url_class, 'public') as url_class from pages left join known on r = page_id % 20)
 select host, url_class, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by host), 6) as share from c group by 1, 2""")
def _(t):
    k = F.col("page_id") % 20
    url = F.coalesce(*[F.when(k == i, u) for i, (u, _, _) in _URLS.items()], F.col("url"))
    return P.url_audit(t.pages.select(url.alias("url"))).withColumn("share", F.round("share", 6))


@query("w1_version_number", "select revision_id, product_id, row_number() over (partition by product_id order by created_at, revision_id) as version from revisions", REV)
def _(t):
    return W.version_number(t.view("revisions"), "product_id", "created_at", "revision_id").select("revision_id", "product_id", "version")


@query("w2_latest_decision", """select revision_id, arg_max(action, decided_at) as action, max(decided_at) as decided_at, count(*) as history_length from decisions group by 1""", ("decisions",))
def _(t):
    return W.latest_decision(t.view("decisions"), "revision_id", "decided_at", "event_id")


@query("w2_decision_history", "select revision_id, event_id, row_number() over (partition by revision_id order by decided_at, event_id) as position from decisions", ("decisions",))
def _(t):
    return W.decision_history(t.view("decisions"), "revision_id", "decided_at", "event_id").select("revision_id", "event_id", "position")


_FOLDED = "lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))"


@query("w3_dedupe_lines", f"select doc_id, image_id, pos, text from (select *, row_number() over (partition by doc_id, {_FOLDED} order by image_id, pos) rn from image_detections) where rn = 1", ("image_detections",))
def _(t):
    return W.dedupe_lines(t.view("image_detections"), ["image_id", "pos"]).select("doc_id", "image_id", "pos", "text")


@query("w4_combine_images", f"""with im as (select p_partkey as doc_id, i as image_id, not (p_partkey % 9 = 0 and i = 1) as success from part, (values (0), (1)) v(i)),
 k as (select d.doc_id, text, confidence, row_number() over (partition by d.doc_id, {_FOLDED} order by d.image_id, pos) rn from image_detections d join im on im.doc_id = d.doc_id and im.image_id = d.image_id and im.success)
 select im.doc_id, im.images, im.failed_images, lines, chars, confidence from (select doc_id, count(*) as images, count(*) filter (where not success) as failed_images from im group by 1) im
 left join (select doc_id, count(*) as lines, sum(length(text))::bigint as chars, round(avg(confidence), 6) as confidence from k where rn = 1 group by 1) g on g.doc_id = im.doc_id""", ("image_detections",))
def _(t):
    images = t.part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("image_id"))
    images = images.withColumn("success", ~((F.col("doc_id") % 9 == 0) & (F.col("image_id") == 1)))
    return W.combine_images(t.view("image_detections"), images, ["image_id", "pos"]).withColumn("confidence", F.round("confidence", 6))


_CODES_SQL = """codes as (select p_partkey % 50 as image_id, p_partkey % 3 <> 0 as valid, 10 as x1, p_partkey % 13 as y1, 10 + p_partkey % 97 as x2, p_partkey % 13 + 20 + p_partkey % 31 as y2,
  case p_partkey % 2 when 0 then 'EAN_13' else 'UPC_A' end as symbology, p_partkey::varchar as raw_value from part)"""


@query("w5_rank_barcodes", f"with {_CODES_SQL} select image_id, raw_value, row_number() over (partition by image_id order by valid desc, (x2 - x1) * (y2 - y1) desc, y1, x1, symbology, raw_value) - 1 as barcode_pos from codes")
def _(t):
    k = F.col("p_partkey")
    codes = t.part.select((k % 50).alias("image_id"), (k % 3 != 0).alias("valid"), F.lit(10).alias("x1"), (k % 13).alias("y1"), (10 + k % 97).alias("x2"),
                          (k % 13 + 20 + k % 31).alias("y2"), F.when(k % 2 == 0, "EAN_13").otherwise("UPC_A").alias("symbology"), k.cast("string").alias("raw_value"))
    return W.rank_barcodes(codes).select("image_id", "raw_value", "barcode_pos")


@query("w6_rank_candidates", """select doc_id, pos, class_id, rank from (select *, row_number() over (partition by doc_id order by class_id, y1, x1, y2, x2, confidence desc) as rank from
 (select doc_id, pos, pos % 3 as class_id, x1, y1, x2, y2, confidence from detections where confidence >= 0.7)) where rank <= 4""", ("detections",))
def _(t):
    return W.rank_candidates(t.view("detections").withColumn("class_id", F.col("pos") % 3), 0.7, 4).select("doc_id", "pos", "class_id", "rank")


@query("w7_recent_first", "select revision_id, created_at from revisions order by created_at desc, revision_id desc limit 50", REV)
def _(t):
    return W.recent_first(t.view("revisions"), "created_at", "revision_id", 50).select("revision_id", "created_at")


@query("w7_top_recent", "select revision_id, created_at from revisions order by created_at desc, revision_id desc limit 5", REV)
def _(t):
    return W.recent_first(t.view("revisions"), "created_at", "revision_id", 5).select("revision_id", "created_at")


def _products(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("product_id"), F.col("p_name").alias("name"), F.when(k % 4 != 0, (k % 101).cast("double")).alias("score"),
                         F.when(k % 5 != 0, F.timestamp_seconds(k * 86400)).alias("date"))


_ORDER_SQL = {"az": "p_name", "za": "p_name desc", "high": "coalesce(case when p_partkey % 4 <> 0 then p_partkey % 101 end, -1) desc",
              "low": "coalesce(case when p_partkey % 4 <> 0 then p_partkey % 101 end, -1)", "newest": "coalesce(case when p_partkey % 5 <> 0 then p_partkey end, 0) desc",
              "oldest": "coalesce(case when p_partkey % 5 <> 0 then p_partkey end, 0)"}

for _how in W.SORTS:
    # The comparison of results ignores order, so each row carries its place in the list.
    def _sorted(t, how=_how):
        return W.product_positions(_products(t), how).select("product_id", "name", "position")
    query(f"w8_sort_products_{_how}", f"select p_partkey as product_id, p_name as name, row_number() over (order by {_ORDER_SQL[_how]}, p_partkey) as position from part")(_sorted)


@query("w9_top_k_per_query", """select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rank from lineitem) where rank <= 5""")
def _(t):
    out = W.top_k_per_query(t.lineitem, "l_suppkey", F.col("l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey"], 5)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("w10_chain_links", "select user_id, event_id, lag(event_id) over (partition by user_id order by ts, event_id) as previous from events")
def _(t):
    return W.chain_links(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", "previous")


@query("u1_union_engines", """select engine, count(*) as n, round(avg(x1), 4) as x1 from (select 'primary' as engine, x1 from detections union all select 'secondary', x1 + (doc_id + pos) % 5 from detections where (doc_id + pos) % 9 <> 0) group by 1""", ("detections",))
def _(t):
    d = t.view("detections")
    other = d.where("(doc_id + pos) % 9 <> 0").withColumn("x1", F.col("x1") + (F.col("doc_id") + F.col("pos")) % 5)
    return W.union_engines(d, other, "primary", "secondary").groupBy("engine").agg(F.count("*").alias("n"), F.round(F.avg("x1"), 4).alias("x1"))


@query("u2_distinct_in_order", """select doc_id, string_agg(w, ' ' order by i) as words from (select doc_id, w, min(i) i from (select doc_id, unnest(string_split(p_name || ' ' || p_type || ' ' || p_name, ' ')) as w,
  generate_subscripts(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '), 1) as i from (select p_partkey as doc_id, * from part)) group by 1, 2) group by 1""")
def _(t):
    words = t.part.select(F.col("p_partkey").alias("doc_id"), F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ").alias("words"))
    return W.distinct_in_order(words, "words").withColumn("words", F.array_join("words", " "))


_REQUIRED = ["net_quantity", "country_of_origin", "maximum_retail_price_mrp", "unit_sale_price"]


@query("u3_missing_from", f"""select p.p_partkey as doc_id, coalesce(string_agg(r.f, ',' order by r.i), '') as missing from part p left join (select p_partkey, r.* from part, (values {", ".join(f"({i}, '{f}')" for i, f in enumerate(_REQUIRED))}) r(i, f)
  where not exists (select 1 from base_fields b where b.doc_id = p_partkey and b.field = r.f)) r on r.p_partkey = p.p_partkey group by 1""", ("base_fields",))
def _(t):
    held = t.view("base_fields").groupBy("doc_id").agg(F.collect_set("field").alias("present"))
    docs = t.part.select(F.col("p_partkey").alias("doc_id")).join(held, "doc_id", "left")
    required = F.array(*[F.lit(f) for f in _REQUIRED])
    present = F.coalesce("present", F.expr("cast(array() as array<string>)"))
    return W.missing_from(docs, required, present).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("u4_intersects", """select count(*) filter (where hit) as hits, count(*) as n from (select len(list_intersect(string_split(p_name, ' '), ['ring', 'red', 'widget'])) > 0 as hit from part)""")
def _(t):
    wanted = F.array(F.lit("ring"), F.lit("red"), F.lit("widget"))
    out = W.intersects(t.part, F.split("p_name", " "), wanted)
    return out.agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))
