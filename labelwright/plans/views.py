"""Inputs derived from the given tables: label documents, detections, listings, barcodes, facts and so on.

The label text is stated once as SQL expressions that both engines read the same way; numbers enter text only
as decimals, because engines print doubles differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions.identifiers import check_digit
from labelwright.functions.sizing import spread
from labelwright.operators.lines import emit, explode_lines, match_keywords, with_lines

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()

# One expression per possible line of a label, over k (key), nm, sz, pr (decimal price), sn, cn.
LABEL_LINES = [
    "case when k % 6 = 0 then concat(nm, ' biscuits') else nm end",
    "case when k % 12 = 5 then 'A. Choco Wafers' end",
    "case when k % 12 = 5 then 'B. Butter Cookies' end",
    "case when k % 12 = 5 then '(2 units x 12.5 g)' end",
    "case when k % 24 = 5 then '(3 units x 10 g)' end",
    "case when k % 8 = 0 then 'NET WEIGHT:' else concat('Net Quantity: ', cast(sz as string), "
    "case k % 3 when 0 then ' g' when 1 then ' ml' else ' kg' end) end",
    "case when k % 8 = 0 then 'Protein' end",
    "case when k % 8 = 0 then '6.6 g' end",
    "case when k % 16 = 0 then concat(cast(sz as string), ' g') end",
    "case when k % 7 = 0 then null when k % 9 = 0 then 'MRP:' else concat('MRP Rs. ', cast(pr as string), "
    "case when k % 11 = 0 then concat(' Rs. ', cast(cast(pr + 10 as decimal(12,2)) as string)) else '' end, "
    "case when k % 5 = 0 then '' else ' (Inclusive of all taxes)' end) end",
    "case when k % 3 = 1 then 'BATCH No.' else concat('Batch No: B', cast(k as string)) end",
    "case when k % 9 = 0 then cast(pr as string) end",
    "case when k % 3 = 1 then concat('A', lpad(cast(k as string), 6, '0')) end",
    "case when k % 4 = 1 then concat('Packed by: ', sn, ', ', cn) else 'Manufactured by:' end",
    "case when k % 5 = 4 then 'NUTRITION INFORMATION' end",
    "concat(sn, ',')",
    "cn",
    "case when k % 13 = 3 then concat('Imported by ', sn, ' Imports Ltd') end",
    "case when k % 5 = 2 then 'MADE IN' else concat('Country of Origin: ', cn) end",
    "case when k % 5 = 2 then 'INDIA' end",
    "case when k % 9 = 4 then 'Mfg. date:' else concat('Mfg ', lpad(cast(1 + k % 12 as string), 2, '0'), '/', "
    "case when k % 17 = 0 then '2031' else '2024' end) end",
    "case when k % 9 = 4 then '15/05/2024' end",
    "case when k % 3 = 2 then concat('Rs ', cast(pr as string), '/kg') end",
    "case when k % 2 = 0 then 'Ingredients: wheat flour, sugar,' end",
    "case when k % 2 = 0 then 'palm fat, salt' end",
    "case when k % 4 = 2 then 'Warning: keep away from children' end",
    "case when k % 6 in (1, 2) then concat('FSSAI Lic. No. ', lpad(cast(k * 7919 as string), 14, '1')) end",
    "case when k % 5 = 1 then lpad(cast(k * 104729 as string), 13, '8') end",
    "case when k % 3 = 0 then concat('Use by ', lpad(cast(1 + k % 28 as string), 2, '0'), '/11/2026') end",
    "case when k % 10 = 0 then 'INCL. OF ALL TAXES' end",
    "case when k % 7 = 3 then 'Pack of 12' end",
    "case when k % 14 = 1 then 'FOR COMPLAINTS CONTACT: CONSUMER' when k % 14 = 8 then null else concat('Consumer Care: ', "
    "case when k % 4 = 0 then '' else concat('care', cast(k as string), '@example.com ') end, '1800-', "
    "lpad(cast(k as string), 7, '0')) end",
    "case when k % 14 = 1 then concat('CARE OFFICE, ', sn, ' Towers') end",
    "case when k % 21 = 2 then '9811022033' end",
]


def _label_base(t) -> DataFrame:
    nation = F.broadcast(t.nation.select("n_nationkey", "n_name"))  # fixed 25 rows at every scale
    supplier = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    suppliers = supplier.groupBy().agg(F.count("*").alias("n_suppliers"))
    part = t.part.crossJoin(F.broadcast(suppliers))  # one row: the supplier count
    joined = part.join(supplier, F.col("s_suppkey") == F.col("p_partkey") % F.col("n_suppliers"))
    return spread(joined, t.part).select(
        F.col("p_partkey").alias("k"), F.col("p_name").alias("nm"), F.col("p_size").alias("sz"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("pr"),
        F.col("s_name").alias("sn"), F.col("n_name").alias("cn"))


def detection_structs(lines: Column, doc_id: Column) -> Column:
    return F.transform(lines, lambda s, i: F.struct(
        i.alias("pos"), s.alias("text"), ((60 + (doc_id * 7 + i * 13) % 40) / F.lit(100.0)).alias("confidence"),
        F.lit(40).alias("x1"), (i * 30).alias("y1"), (F.length(s) * 8 + 40).alias("x2"), (i * 30 + 22).alias("y2")))


def label_docs(t) -> DataFrame:
    """One row per label: lines and detections as arrays. A single scan of part."""
    lines = F.array_compact(F.array(*[F.expr(e) for e in LABEL_LINES]))
    return (_label_base(t).select(F.col("k").alias("doc_id"), "brand", "category", lines.alias("lines"))
            .withColumn("detections", detection_structs(F.col("lines"), F.col("doc_id"))))


def label_lines(t) -> DataFrame:
    return explode_lines(label_docs(t))


def detections(t) -> DataFrame:
    return emit(label_docs(t), F.col("detections"))


def text_docs(t) -> DataFrame:
    return with_lines(spread(t.documents)).select("doc_id", "source", "lang", "text", "lines")


def _alias_values(table: dict[str, list[str]], form) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({quote(f)}, {i}, {quote(form(a))})" for f, al in table.items() for i, a in enumerate(al))


_DUCK_LABEL_LINES = """label_lines as (
 select doc_id, row_number() over (partition by doc_id order by ord) - 1 as n, text from (
  select doc_id, unnest(ls) as text, generate_subscripts(ls, 1) as ord from (
   select p.k as doc_id, [{lines}] as ls from label_base p)) where text is not null)"""

def base_fields(t) -> DataFrame:
    """Keyword lines as fields, with the confidence of their line."""
    conf = (60 + (F.col("doc_id") * 7 + F.col("n") * 13) % 40) / F.lit(100.0)
    return match_keywords(label_docs(t)).select("doc_id", "field", F.col("text").alias("value"), conf.alias("confidence"))


REGION_CLASS_SQL = ("element_at(array('product_identity','mrp','unit_sale_price','net_quantity','entity_details',"
                    "'country_of_origin','mfg_date_batch','consumer_care','other'), cast((doc_id + pos) % 9 as int) + 1)")


def regions(t) -> DataFrame:
    return detections(t).select("doc_id", "pos", F.expr(REGION_CLASS_SQL).alias("class_name"),
                    ((F.col("doc_id") * 3 + F.col("pos") * 5) % 10 / F.lit(10.0)).alias("detection_confidence"),
                    F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("text")).alias("full_text"), "confidence")


def words(t) -> DataFrame:
    """Word boxes of label lines, as a word-level recogniser would give them."""
    w = label_lines(t).select("doc_id", "n", F.posexplode(F.split("text", " ")).alias("word", "text"))
    return w.select("doc_id", F.lit(1).alias("block"), F.floor(F.col("n") / 4).cast("int").alias("par"), F.col("n").alias("line"),
                    "word", "text",
                    F.when((F.col("doc_id") + F.col("word")) % 11 == 0, -1.0)
                    .otherwise((50 + (F.col("doc_id") + F.col("n") * 3 + F.col("word") * 7) % 60).cast("double")).alias("conf"),
                    (40 + F.col("word") * 60).alias("left"), (30 * F.col("n")).alias("top"),
                    (8 * F.length("text")).alias("width"), F.lit(22).alias("height"))


def panel_boxes(t) -> DataFrame:
    side = F.when(F.col("doc_id") % 19 == 0, 250).otherwise(500)
    x1, y1 = F.col("pos") * 37 % 200, (F.col("pos") * 53 + F.col("doc_id")) % 300
    return detections(t).select("doc_id", "pos", x1.alias("x1"), y1.alias("y1"), (x1 + 100 + F.col("pos") * 5).alias("x2"),
                                (y1 + 80).alias("y2"), side.alias("frame_w"), side.alias("frame_h"))


def quads(t) -> DataFrame:
    k = F.col("p_partkey")
    w, skew = 300 + k % 100, k % 5 * 20
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    ten = F.lit(10)
    return t.part.select(k.alias("code_id"), F.array(
        point(ten, ten), point(ten + w, ten + skew), point(ten + w, F.lit(110)), point(ten, F.lit(110))).alias("polygon"),
        F.when(k % 13 == 0, 200.0).otherwise(640.0).alias("frame_w"), F.lit(480.0).alias("frame_h"),
        F.when(k % 9 != 0, 37.29).alias("reference_mm"))


def revisions(t) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 7 != 0, F.when(F.col("o_orderstatus") == "O", "PENDING_OFFICIAL_REVIEW")
                    .when(F.col("o_orderstatus") == "P", "UNDER_OFFICIAL_REVIEW").otherwise("DECISION_RECORDED"))
    return t.orders.select(
        k.alias("revision_id"), F.col("o_custkey").alias("product_id"), (F.col("o_custkey") + k % 3 * 1000000).alias("manufacturer_id"),
        F.col("o_orderdate").alias("created_at"), status.alias("review_status"), F.when(k % 5 != 0, (k % 101).cast("double")).alias("score"),
        F.when(k % 4 != 0, k * 10).alias("image_key"), F.col("o_orderpriority").alias("priority"))


def decisions(t) -> DataFrame:
    actions = F.array(*[F.lit(a) for a in ("APPROVED", "REJECTED", "NEEDS_CORRECTION", "REQUIRES_PHYSICAL_INSPECTION")])
    return t.events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("revision_id"), "event_id", F.get(actions, (F.col("event_id") % 4).cast("int")).alias("action"), F.col("ts").alias("decided_at"))


def image_detections(t) -> DataFrame:
    """Two images of each label; the second repeats lines in upper case and differs in some."""
    both = detections(t).withColumn("image_id", F.explode(F.array(F.lit(0), F.lit(1))))
    second = F.when(F.col("pos") % 3 == 0, F.concat(F.upper("text"), F.lit(" "))).when(F.col("pos") % 3 == 1, F.concat(F.col("text"), F.lit(" x"))).otherwise(F.col("text"))
    return both.select("doc_id", "image_id", "pos", F.when(F.col("image_id") == 1, second).otherwise(F.col("text")).alias("text"), "confidence")


def physical_fields(t) -> DataFrame:
    """Label values as confirmed on the package; some are missing."""
    rows = [("net_quantity", "concat('Net Quantity: ', cast(sz as string), case k % 3 when 0 then ' g' when 1 then ' ml' else ' kg' end)", "k % 19 <> 0"),
            ("country_of_origin", "concat('Country of Origin: ', cn)", "k % 19 <> 1"),
            ("manufacturer_packer_importer_details", "concat('Manufactured by: ', sn, ', ', cn)", "k % 19 <> 2"),
            ("maximum_retail_price_mrp", "cast(pr as string)", "k % 19 <> 3")]
    structs = [F.when(F.expr(cond), F.struct(F.lit(f).alias("field"), F.expr(v).alias("value"))) for f, v, cond in rows]
    return emit(_label_base(t).withColumn("doc_id", F.col("k")), F.array_compact(F.array(*structs)))


LISTING = {
    "retrieval_status": "case when k % 23 = 0 then 'HTTP_ERROR' else 'SUCCESS' end",
    "net_quantity": "case when k % 17 = 0 then null when k % 3 = 2 then concat(cast(sz * 1000 as string), ' g') when k % 14 = 1 then 'a lot' when k % 15 = 3 then concat(cast(sz as string), ' ml') else concat(cast(sz as string), case k % 3 when 0 then ' g' else ' ml' end) end",
    "country_of_origin": "case when k % 17 = 1 then null when k % 8 = 0 then 'Made in Elsewhere' else concat('Made in  ', upper(cn), '.') end",
    "manufacturer": "case when k % 7 = 0 then null when k % 9 = 0 then 'Somebody Else' else upper(sn) end",
    "packer_importer": "case when k % 2 = 0 then sn end",
    "mrp": "case when k % 17 = 3 then null when k % 12 = 0 then 'on request' else concat('Rs. ', cast(cast(pr + case when k % 13 = 0 then 1 else 0 end as decimal(12,2)) as string)) end",
}


def listing(t) -> DataFrame:
    return _label_base(t).select(F.col("k").alias("doc_id"), *[F.expr(e).alias(c) for c, e in LISTING.items()])


def barcodes(t) -> DataFrame:
    k = F.col("p_partkey")
    body = F.lpad((k * 7919).cast("string"), 12, "0")
    check = check_digit(body)
    raw = (F.when(k % 9 == 1, F.concat(F.lit("AB"), k.cast("string"))).when(k % 25 == 4, "0425-2614")
           .when(k % 6 == 0, F.concat(body, ((check.cast("int") + 1) % 10).cast("string"))).otherwise(F.concat(body, check)))
    names = F.array(F.lit("EAN_13"), F.lit(None), F.lit("ean 13"), F.lit("QR"))
    symbology = F.when(k % 25 == 4, "UPC-E").otherwise(F.get(names, (k % 4).cast("int")))
    return t.part.select(k.alias("doc_id"), raw.alias("raw_value"), symbology.alias("symbology"), "p_name", "p_brand", "p_size")


# Facts of a label: namespace, key, when the fact is present, when it is known, kind of value, value.
FACTS = [
    ("package", "package_type", "k % 17 <> 0", "true", "v_str", "case when k % 10 = 0 then 'wholesale' else 'retail' end"),
    ("package", "net_quantity_value", "true", "k % 6 <> 5", "v_num", "cast(sz as double)"),
    ("package", "net_quantity_unit", "true", "true", "v_str", "case k % 3 when 0 then 'g' when 1 then 'ml' else 'kg' end"),
    ("package", "net_quantity_basis", "true", "k % 19 <> 0", "v_str", "case k % 3 when 1 then 'volume' else 'mass' end"),
    ("package", "commodity", "k % 23 <> 0", "true", "v_str", "case when k % 9 <> 0 then nm end"),
    ("package", "is_export", "k % 4 = 0", "true", "v_bool", "k % 8 = 0"),
    ("label", "mrp_text", "k % 7 <> 0", "true", "v_str", "concat('MRP Rs. ', cast(pr as string), case when k % 5 = 0 then '' else ' (Inclusive of all taxes)' end)"),
    ("label", "mrp_value", "k % 7 <> 0", "true", "v_num", "cast(pr as double)"),
    ("label", "mrp_inclusive_of_taxes_wording", "k % 7 <> 0", "true", "v_bool", "k % 5 <> 0"),
    ("label", "country_of_origin", "k % 11 <> 0", "true", "v_str", "cn"),
    ("label", "claims", "k % 3 <> 0", "true", "v_arr", "ARR(nm, category)"),
    ("sale", "price", "k % 2 = 0", "true", "v_num", "cast(pr + (k % 40) * 60 - 500 as double)"),
    ("entity", "role", "k % 13 <> 0", "true", "v_str", "case k % 3 when 0 then 'manufacturer' when 1 then 'packer' else 'importer' end"),
]


def facts(t) -> DataFrame:
    """Long facts; absent, unknown and known-null facts all occur."""
    def part(kind: str, name: str, sql_type: str, value: str, known: str) -> Column:
        expr = value.replace("ARR(", "array(") if kind == name else "null"
        return F.expr(f"case when {known} then cast({expr} as {sql_type}) end").alias(name)
    rows = [F.when(F.expr(present), F.struct(
        F.lit(ns).alias("namespace"), F.lit(key).alias("key"), F.expr(known).alias("known"),
        part(kind, "v_num", "double", value, known), part(kind, "v_str", "string", value, known),
        part(kind, "v_bool", "boolean", value, known), part(kind, "v_arr", "array<string>", value, known),
        F.expr("array(concat('region_', cast(k % 5 as string)))" if kind != "v_bool" else "cast(array() as array<string>)").alias("evidence_ids")))
        for ns, key, present, known, kind, value in FACTS]
    return emit(_label_base(t).withColumn("doc_id", F.col("k")), F.array_compact(F.array(*rows)))


def _duck_facts() -> str:
    """One row per document; ``k_<key>`` says the fact is known, ``v_<key>`` is its value."""
    columns = []
    for _ns, key, present, known, _kind, value in FACTS:
        value = value.replace("ARR(nm, category)", "[nm, category]")
        columns.append(f"({present}) and ({known}) as k_{key}, case when ({present}) and ({known}) then {value} end as v_{key}")
    return "wide_facts as (select k as doc_id, " + ",\n  ".join(columns) + " from label_base)"


SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "label_base": ((), """label_base as (select p.p_partkey k, p.p_name nm, p.p_size sz, p.p_brand brand, p.p_type category,
  cast(p.p_retailprice as decimal(12,2)) pr, s.s_name sn, n.n_name cn from part p
  join supplier s on s.s_suppkey = p.p_partkey % (select count(*) from supplier)
  join nation n on n.n_nationkey = s.s_nationkey)"""),
    "label_lines": (("label_base",), _DUCK_LABEL_LINES.format(lines=",\n    ".join(LABEL_LINES))),
    "detections": (("label_lines",), """detections as (select doc_id, n as pos, text,
  (60 + (doc_id * 7 + n * 13) % 40) / 100.0::double as confidence, 40 as x1, 30 * n as y1,
  40 + 8 * length(text) as x2, 30 * n + 22 as y2 from label_lines)"""),
    "wide_facts": (("label_base",), _duck_facts()),
    "listing": (("label_base",), "listing as (select k as doc_id, " + ", ".join(f"{e} as {c}" for c, e in LISTING.items()) + " from label_base)"),
    "physical": (("label_base",), """physical as (select k as doc_id, 'net_quantity' as field, 'Net Quantity: ' || sz || case k % 3 when 0 then ' g' when 1 then ' ml' else ' kg' end as value from label_base where k % 19 <> 0
  union all select k, 'country_of_origin', 'Country of Origin: ' || cn from label_base where k % 19 <> 1 union all select k, 'manufacturer_packer_importer_details', 'Manufactured by: ' || sn || ', ' || cn from label_base where k % 19 <> 2
  union all select k, 'maximum_retail_price_mrp', cast(pr as varchar) from label_base where k % 19 <> 3)"""),
    "barcodes": ((), """barcodes as (select p_partkey as doc_id, case when p_partkey % 9 = 1 then 'AB' || p_partkey when p_partkey % 25 = 4 then '0425-2614' when p_partkey % 6 = 0 then body || (ck + 1) % 10 else body || ck end as raw_value,
  case when p_partkey % 25 = 4 then 'UPC-E' else ['EAN_13', null, 'ean 13', 'QR'][p_partkey % 4 + 1] end as symbology, p_name, p_brand, p_size from
  (select *, (10 - list_sum(list_transform(range(0, 12), lambda i: substr(body, (12 - i)::int, 1)::int * case when i % 2 = 0 then 3 else 1 end))::int % 10) % 10 as ck from (select *, lpad((p_partkey * 7919)::varchar, 12, '0') as body from part)))"""),
    "text_lines": ((), r"""text_lines as (select doc_id, row_number() over (partition by doc_id order by ord) - 1 as n, text from (
  select doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as text,
   generate_subscripts(string_split(text, chr(10)), 1) as ord from documents) where length(text) > 0)"""),
}

SQL_VIEWS.update({
    "keywords": (("label_lines",), f"""lit as (select doc_id, field, n, text from (
  select l.doc_id, a.field, l.n, l.text, row_number() over (partition by l.doc_id, a.field order by a.ord, l.n) rn
  from label_lines l join (values {_alias_values(P.FIELD_ALIASES, str)}) a(field, ord, alias) on contains(lower(l.text), a.alias)) where rn = 1),
 pat as (select doc_id, field, n, text from (
  select l.doc_id, a.field, l.n, l.text, row_number() over (partition by l.doc_id, a.field order by a.ord, l.n) rn
  from label_lines l join (values {_alias_values(P.FIELD_PATTERNS, P.re2)}) a(field, ord, p) on regexp_matches(l.text, a.p)) where rn = 1),
 kw as (select doc_id, field, n, text, 'literal' as source from lit union all
  select p.*, 'pattern' from pat p where not exists (select 1 from lit where lit.doc_id = p.doc_id and lit.field = p.field))"""),
    "base_fields": (("keywords",), """base_fields as (select doc_id, field, text as value,
  (60 + (doc_id * 7 + n * 13) % 40) / 100.0::double as confidence from kw)"""),
    "regions": (("detections",), """regions as (select doc_id, pos, ['product_identity','mrp','unit_sale_price','net_quantity','entity_details',
  'country_of_origin','mfg_date_batch','consumer_care','other'][(doc_id + pos) % 9 + 1] as class_name,
  ((doc_id * 3 + pos * 5) % 10) / 10.0::double as detection_confidence, case when pos % 5 = 0 then '' else text end as full_text, confidence
  from detections)"""),
    "revisions": ((), """revisions as (select o_orderkey as revision_id, o_custkey as product_id, o_custkey + o_orderkey % 3 * 1000000 as manufacturer_id, o_orderdate as created_at,
  case when o_orderkey % 7 <> 0 then case o_orderstatus when 'O' then 'PENDING_OFFICIAL_REVIEW' when 'P' then 'UNDER_OFFICIAL_REVIEW' else 'DECISION_RECORDED' end end as review_status,
  case when o_orderkey % 5 <> 0 then (o_orderkey % 101)::double end as score, case when o_orderkey % 4 <> 0 then o_orderkey * 10 end as image_key, o_orderpriority as priority from orders)"""),
    "decisions": ((), """decisions as (select user_id as revision_id, event_id, ['APPROVED','REJECTED','NEEDS_CORRECTION','REQUIRES_PHYSICAL_INSPECTION'][event_id % 4 + 1] as action, ts as decided_at
  from events where event_type = 'purchase')"""),
    "image_detections": (("detections",), """image_detections as (select doc_id, image_id, pos, case when image_id = 1 then case pos % 3 when 0 then upper(text) || ' ' when 1 then text || ' x' else text end else text end as text, confidence
  from detections, (values (0), (1)) i(image_id))"""),
    "words": (("label_lines",), """words as (select doc_id, 1 as block, n // 4 as par, n as line, word, text,
  case when (doc_id + word) % 11 = 0 then -1.0 else 50 + (doc_id + n * 3 + word * 7) % 60 end::double as conf, 40 + word * 60 as left_, 30 * n as top,
  8 * length(text) as width, 22 as height from (select doc_id, n, unnest(string_split(text, ' ')) as text,
  generate_subscripts(string_split(text, ' '), 1) - 1 as word from label_lines))"""),
    "panel_boxes": (("detections",), """panel_boxes as (select doc_id, pos, x1, y1, x1 + 100 + pos * 5 as x2, y1 + 80 as y2, side as frame_w, side as frame_h from (
  select doc_id, pos, pos * 37 % 200 as x1, (pos * 53 + doc_id) % 300 as y1, case when doc_id % 19 = 0 then 250 else 500 end as side from detections))"""),
})


def with_views(names: tuple[str, ...], body: str) -> str:
    """Prefix a SQL body with the views it uses, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in SQL_VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body.strip()
    prefix = ",\n".join(SQL_VIEWS[n][1] for n in ordered)
    body = body.strip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {prefix},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {prefix},\n{body[5:]}"
    return f"with {prefix}\n{body}"
