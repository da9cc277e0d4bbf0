"""Queries over web pages and retrieval (survey S5, L, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions.sizing import spread
from labelwright.operators import listing as L
from labelwright.operators import metrics as X
from labelwright.operators import retrieval as R
from labelwright.plans.registry import query

# Product mark-up put into some of the given pages, as SQL text over page_id k; the rest of the page is as given.
_LD = ("case when k % 5 = 0 then concat('<script type=\"application/ld+json\">{\"@type\":\"Product\",\"name\":\"Item ', cast(k as string), '\",\"brand\":{\"name\":\"Br ', cast(k % 7 as string), "
       "'\"},\"countryOfOrigin\":\"India\",\"offers\":[{\"price\":', cast(k as string), ',\"priceCurrency\":\"INR\"}],\"additionalProperty\":[{\"name\":\"Net Weight\",\"value\":\"', cast(k as string), ' g\"}]}</script>') "
       "when k % 5 = 1 then concat('<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":\"WebPage\"},{\"@type\":[\"Product\"],\"name\":\"Graph ', cast(k as string), '\",\"brand\":\"Plain\"},{\"@type\":\"Product\",\"name\":\"Second\"}]}</script>') "
       "when k % 5 = 2 then '<script type=\"application/ld+json\">{broken</script>' else '' end")
_META = ("case when k % 3 = 0 then concat('<meta property=\"og:title\" content=\"Og &amp; ', cast(k as string), '\"><meta name=\"product:brand\" content=\"MetaBr\">"
         "<meta property=\"product:price:amount\" content=\"', cast(k + 10 as string), '\"><meta property=\"product:price:currency\" content=\"INR\">') else '' end")
_TEXT = ("case when k % 4 = 0 then concat('<div>Net Quantity: ', case when k % 8 = 0 then 'plenty' else concat(cast(k as string), ' ml.') end, '</div><p>Made in: Nepal</p><p>MRP Rs. ', cast(k * 3 as string), '</p>"
         "<p>Manufactured by: Maker ', cast(k as string), ';</p>') else '' end")
_ODD = ("case when k % 6 = 1 then '<p title=\"a > b\">It&#8217;s &hellip; &copy; &#x1F600; &eacute;t&eacute; &notin &amp;lt; &unknown; x < y &#150;</p><!-- <p>hidden</p> --><?php x ?><p>T&#0;&#xD800;</p>' else '' end")
PAGE_EXPR = f"replace(replace(html, '</head>', concat({_META}, {_LD}, '</head>')), '</body>', concat({_TEXT}, {_ODD}, '</body>'))"
_PAGES_SQL = f"pg as (select page_id, {PAGE_EXPR.replace('cast(', 'cast(')} as html from (select page_id, page_id as k, html from pages))"


def product_pages(t):
    return spread(t.pages).withColumn("k", F.col("page_id")).select("page_id", F.expr(PAGE_EXPR).alias("html"))


def parts(t):
    return L.page_parts(product_pages(t))


@query("s5_admit_pages", """select status as retrieval_status, count(*) as n from (select case when page_id % 11 = 0 then 'HTTP_ERROR' when page_id % 7 = 0 then 'UNSUPPORTED_CONTENT_TYPE' when page_id % 13 = 0 then 'RESPONSE_TOO_LARGE' when page_id % 17 = 0 then 'EMPTY_RESPONSE' else 'SUCCESS' end as status from pages) group by 1""")
def _(t):
    k = F.col("page_id")
    rows = t.pages.select("page_id", F.when(k % 17 != 0, F.col("html")).alias("html"), F.when(k % 11 == 0, 404).otherwise(200).alias("http_status"),
                          F.when(k % 7 == 0, "image/png").otherwise("Text/HTML; charset=utf-8").alias("content_type"), F.when(k % 13 == 0, 3_000_000).alias("declared_length"))
    return L.admit_pages(rows).groupBy("retrieval_status").agg(F.count("*").alias("n"))


_ODD_REFERENCES = {"&#8217;": "\u2019", "&hellip;": "\u2026", "&copy;": "\u00a9", "&#x1F600;": "\U0001F600", "&eacute;": "\u00e9", "&notin ": "\u00acin ", "&#150;": "\u2013", "&middot;": "\u00b7", "&#0;": "\ufffd", "&#xD800;": "\ufffd"}
_UNESCAPE = "replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
for _reference, _character in _ODD_REFERENCES.items():
    _UNESCAPE = _UNESCAPE.replace("{c}", f"replace({{c}}, '{_reference}', '{_character}')")
_PIECES_SQL = f"""v as (select page_id, unnest(ls) as s, generate_subscripts(ls, 1) as at_no from (select page_id, string_split_regex(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<title\\b.*?</title>|<!--.*?-->|<![^>]*>|<\\?[^>]*>', chr(1), 'g'),
   '(?s)\\x01|</[a-zA-Z][^>]*>|<[a-zA-Z](?:[^"''>]|"[^"]*"|''[^'']*'')*>') as ls from pg)),
 u as (select page_id, at_no, trim({_UNESCAPE.format(c='s')}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) as s from v)"""


@query("l1_page_title", f"with {_PAGES_SQL} select page_id, trim({_UNESCAPE.format(c='ti')}) as title from (select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as ti from pg)")
def _(t):
    return parts(t).select("page_id", "title")


@query("l1_page_text", f"with {_PAGES_SQL}, {_PIECES_SQL} select page_id, count(*) as n_pieces, sum(length(s))::bigint as chars from u where length(s) > 0 group by 1")
def _(t):
    return parts(t).select("page_id", F.size("text_lines").cast("bigint").alias("n_pieces"), F.aggregate("text_lines", F.lit(0), lambda a, s: a + F.length(s)).cast("bigint").alias("chars"))


@query("l1_page_lines", f"with {_PAGES_SQL}, {_PIECES_SQL} select page_id, (row_number() over (partition by page_id order by at_no) - 1)::int as n, s as text from u where length(s) > 0")
def _(t):
    return parts(t).select("page_id", F.posexplode_outer("text_lines").alias("n", "text")).where("n is not null")


@query("l2_jsonld_products", "select page_id, case page_id % 5 when 0 then 1 when 1 then 2 else 0 end as products, case when page_id % 5 = 2 then 1 else 0 end as bad_blocks from pages")
def _(t):
    return L.jsonld_products(parts(t)).drop("node")


_LD_SQL = """ld as (select page_id, unnest(case page_id % 5 when 0 then [{'field': 'product_name', 'value': 'Item ' || page_id}, {'field': 'brand', 'value': 'Br ' || page_id % 7}, {'field': 'country_of_origin', 'value': 'India'}, {'field': 'price', 'value': 'INR ' || page_id}, {'field': 'net_quantity', 'value': page_id || ' g'}]
   when 1 then [{'field': 'product_name', 'value': 'Graph ' || page_id}, {'field': 'brand', 'value': 'Plain'}] else [] end, recursive := true) from pages)"""


@query("l3_jsonld_fields", f"with {_LD_SQL} select page_id, field, value from ld")
def _(t):
    return L.jsonld_fields(parts(t)).drop("ord")


_META_SQL = """mt as (select page_id, unnest(case when page_id % 3 = 0 then [{'field': 'product_name', 'value': 'Og & ' || page_id}, {'field': 'brand', 'value': 'MetaBr'}, {'field': 'price', 'value': 'INR ' || (page_id + 10)}] else [] end, recursive := true) from pages)"""


@query("l4_meta_fields", f"with {_META_SQL} select page_id, field, value from mt")
def _(t):
    return L.meta_fields(parts(t))


_LABEL_SQL = """lb as (select page_id, field, value from (select page_id, unnest(case when page_id % 4 = 0 and contains(html, '</body>') then [{'field': 'country_of_origin', 'value': 'Nepal'}, {'field': 'mrp', 'value': (page_id * 3)::varchar}, {'field': 'manufacturer', 'value': 'Maker ' || page_id},
   {'field': 'net_quantity', 'value': case when page_id % 8 <> 0 then page_id || ' ml' end}] else [] end, recursive := true) from pages) where value is not null)"""


@query("l5_label_fields", f"with {_LABEL_SQL} select page_id, field, value from lb")
def _(t):
    return L.label_fields(parts(t))


_RESOLVED_SQL = f"""{_PAGES_SQL}, {_LD_SQL}, {_META_SQL}, {_LABEL_SQL}, al as (select page_id, field, value, 1 as pr, 'json-ld' as source from ld union all select page_id, field, value, 2, 'meta-tag' from mt union all select page_id, field, value, 3, 'text-label' from lb
  union all select page_id, 'product_name', trim({_UNESCAPE.format(c="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), 4, 'page-title' from pg),
 rs as (select p.page_id, f.field, arg_min(value, pr) as value, arg_min(source, pr) as source from pages p cross join (values {", ".join(f"('{f}')" for f in L.LISTING_FIELDS)}) f(field) left join al on al.page_id = p.page_id and al.field = f.field group by 1, 2)"""


@query("l6_resolve_by_priority", f"with {_RESOLVED_SQL} select page_id, field, value, source from rs")
def _(t):
    return L.resolve_by_priority(parts(t))


@query("l6_listing_rows", f"with {_RESOLVED_SQL} select page_id, 'SUCCESS' as retrieval_status, count(*) filter (where value is not null) as available, coalesce(string_agg(field, ',' order by field) filter (where value is null), '') as unavailable from rs group by 1")
def _(t):
    rows = L.listing_rows(parts(t))
    n = sum((F.col(f).isNotNull().cast("bigint") for f in L.LISTING_FIELDS), F.lit(0).cast("bigint"))
    return rows.select("page_id", "retrieval_status", n.alias("available"), "unavailable")


@query("l7_flat_metadata", "select page_id, case when page_id % 5 = 0 then 'Item ' || page_id end as product_name, case when page_id % 5 = 0 then 'Br ' || page_id % 7 end as brand, null::varchar as price from pages where page_id % 5 < 2")
def _(t):
    return L.flat_metadata(parts(t))


# ---- retrieval ----------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
_BM25_SQL = f"""qt as (select distinct query_id, unnest({_TOK.format(c='text')}) as term from qs), pt as (select doc_id as passage_id, {_TOK.format(c='text')} as ts from documents),
 st as (select count(*) n, avg(len(ts)) av from pt), tf as (select passage_id, len(ts) as ln, term, count(*) tf from (select passage_id, ts, unnest(ts) as term from pt) where term in (select term from qt) group by 1, 2, 3),
 dfq as (select term, count(*) df from tf group by 1), sc as (select q.query_id, tf.passage_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * tf.ln / av))), 6) as score from qt q join tf using (term) join dfq using (term) cross join st group by 1, 2),
 rk as (select *, row_number() over (partition by query_id order by score desc, passage_id) as rank from sc qualify rank <= 10)"""
_QS = "qs as (select item_id as query_id, text from benchmark)"


def _queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _bm25(t):
    return R.bm25(_queries(t), spread(t.documents).select(F.col("doc_id").alias("passage_id"), "text"))


@query("k1_bm25", f"with {_QS}, {_BM25_SQL} select query_id, passage_id, round(score, 4) as score, rank from rk")
def _(t):
    return _bm25(t).withColumn("score", F.round("score", 4))


_DENSE_SQL = """nv as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as v from embeddings),
 dn as (select a.vec_id as query_id, b.vec_id, round(list_dot_product(a.v, b.v), 6) as score from nv a cross join nv b where a.vec_id % 5 = 0),
 dr as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from dn qualify rank <= 10)"""


def _dense(t):
    queries = t.embeddings.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_topk(queries, t.embeddings, 10)


@query("k2_dense_topk", f"with {_DENSE_SQL} select query_id, vec_id, score, rank from dr")
def _(t):
    return _dense(t)


@query("k3_rrf", f"""with {_QS}, {_BM25_SQL}, l2 as (select query_id, passage_id, row_number() over (partition by query_id order by passage_id desc) as rank from rk), u as (select query_id, passage_id, rank from rk union all select query_id, passage_id, rank from l2),
 f as (select query_id, passage_id, round(sum(1.0 / (60 + rank)), 9) as score from u group by 1, 2) select *, row_number() over (partition by query_id order by score desc, passage_id) as rank from f qualify rank <= 5""")
def _(t):
    from pyspark.sql import Window as W
    first = _bm25(t)
    second = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("passage_id").desc())))
    return R.rrf([first, second], k=5)


_SYN = [("than", "rather instead"), ("the ", "article"), ("erat", "era rate"), ("zzz", "nothing")]


@query("k4_expand_queries", f"""with sy(pattern, expansion) as (values {", ".join(f"('{a}', '{b}')" for a, b in _SYN)}), h as (select item_id, string_agg(distinct expansion, ' ' order by expansion) as more from benchmark join sy on contains(lower(text), pattern) group by 1)
 select b.item_id as query_id, concat_ws(' ', text, more) as text, more is not null as rewritten from benchmark b left join h using (item_id)""")
def _(t):
    return R.expand_queries(_queries(t), t.spark.createDataFrame(_SYN, "pattern string, expansion string"))


_FLAG_SQL = """ex as (select query_id, passage_id from rk where (query_id % 4 = 0 and rank = 1) or (query_id % 4 = 1 and rank = 2) or (query_id % 4 = 2 and rank = 6)), exr as (select distinct query_id, passage_id % 7 as r from ex),
 fl as (select q.query_id, ['exact','topic','adversarial_a'][q.query_id % 3 + 1] as style, exists (select 1 from ex where ex.query_id = q.query_id) as app,
   exists (select 1 from ex join rk using (query_id, passage_id) where ex.query_id = q.query_id and rank = 1) as t1, exists (select 1 from ex join rk using (query_id, passage_id) where ex.query_id = q.query_id and rank <= 3) as t3,
   exists (select 1 from exr join rk on rk.query_id = exr.query_id and rk.passage_id % 7 = exr.r where exr.query_id = q.query_id and rank = 1) as rr, coalesce((select max(score) / 50 from rk where rk.query_id = q.query_id and rank = 1), 0) as ts from qs q)"""


def _flags(t):
    ranked = _bm25(t).select("query_id", "rank", F.col("passage_id").alias("provision_id"), (F.col("passage_id") % 7).alias("rule_id"), (F.col("score") / 50).alias("score"))
    q_, r_ = F.col("query_id") % 4, F.col("rank")
    expected = ranked.where(((q_ == 0) & (r_ == 1)) | ((q_ == 1) & (r_ == 2)) | ((q_ == 2) & (r_ == 6))).select("query_id", "provision_id", "rule_id")
    names = F.array(F.lit("exact"), F.lit("topic"), F.lit("adversarial_a"))
    return X.retrieval_flags(ranked, _queries(t).select("query_id", F.get(names, (F.col("query_id") % 3).cast("int")).alias("style")), expected)


_F = f"with {_QS}, {_BM25_SQL}, {_FLAG_SQL}"


@query("k5_retrieval_metrics", f"""{_F} select count(*) filter (where app) as applicable_queries, count(*) filter (where not app) as no_result_queries, round(avg(t1::int) filter (where app), 4) as top1_accuracy, round(avg(t3::int) filter (where app), 4) as top3_recall,
 round(avg((not rr)::int) filter (where app), 4) as wrong_rule_rate, round(avg((rr and not t1)::int) filter (where app), 4) as wrong_field_rate, round(avg((not t1)::int) filter (where app and style like 'adversarial%'), 4) as adversarial_class_b_rate from fl""")
def _(t):
    return X.retrieval_metrics(_flags(t))


@query("k6_threshold_sweep", f"{_F} select th::double as threshold, count(*) filter (where not app and ts < th) as abstained, count(*) filter (where not app) as no_result_total, count(*) filter (where app and t1 and ts >= th) as retained, count(*) filter (where app and t1 and ts < th) as withheld from fl cross join (values (0.55), (0.60), (0.65), (0.70), (0.75), (0.80)) h(th) group by 1")
def _(t):
    return X.threshold_sweep(_flags(t))


@query("k7_by_style", f"{_F} select style, count(*) filter (where t1) as correct, count(*) as total from fl where app group by 1")
def _(t):
    return X.by_style(_flags(t))


_NUMS = "list_distinct(list_transform(regexp_extract_all({c}, '\\b\\d[\\d,]*(?:\\.\\d+)?\\s*%?'), lambda n: regexp_replace(n, '[,%\\s]', '', 'g')))"


def _answers(t):
    k = F.col("p_partkey")
    rule = lambda c: F.concat(F.lit("Rule "), c.cast("string"), F.lit("(1)"))
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return t.part.select(
        k.alias("answer_id"), F.when(k % 10 != 0, F.concat(F.lit("Per "), rule(F.when(k % 4 == 0, k % 9 + 1).otherwise(k % 9)), F.lit(" the price is "), price, F.when(k % 3 == 0, " or 5%").otherwise(""))).alias("answer"),
        F.when(k % 7 != 0, F.concat(F.lit("price "), price, F.lit(" under 1 "), (k % 9).cast("string"))).alias("cited_text"),
        F.when(k % 7 != 0, F.array(rule(k % 9))).otherwise(F.expr("cast(array() as array<string>)")).alias("cited_clauses"), F.when(k % 7 != 0, 1).otherwise(0).alias("n_citations"))


_GROUND_SQL = f"""an as (select p_partkey as answer_id, case when p_partkey % 10 <> 0 then 'Per Rule ' || case when p_partkey % 4 = 0 then p_partkey % 9 + 1 else p_partkey % 9 end || '(1) the price is ' || p_retailprice::decimal(12,2) || case when p_partkey % 3 = 0 then ' or 5%' else '' end end as a,
   case when p_partkey % 7 <> 0 then 'price ' || p_retailprice::decimal(12,2) || ' under 1 ' || p_partkey % 9 else '' end as c, p_partkey % 7 <> 0 as ci, 'Rule ' || p_partkey % 9 || '(1)' as cl from part),
 gr as (select answer_id, case when a is null then 0 else len(list_filter({_NUMS.format(c='a')}, lambda n: not list_contains({_NUMS.format(c='c')}, n))) end::int as unsupported_numbers,
  case when a is null then 0 else len(list_filter(list_distinct(regexp_extract_all(a, '(?i)Rule\\s+\\d+(?:\\([^)]+\\))*')), lambda x: not (ci and x = cl))) end::int as unsupported_clauses, a is not null and not ci as uncited from an)"""


@query("k8_groundedness", f"with {_GROUND_SQL} select *, unsupported_numbers = 0 and unsupported_clauses = 0 and not uncited as grounded from gr")
def _(t):
    return X.groundedness(_answers(t)).select("answer_id", "unsupported_numbers", "unsupported_clauses", "uncited", "grounded")


@query("k8_groundedness_rate", f"with {_GROUND_SQL}, z as (select unsupported_numbers = 0 and unsupported_clauses = 0 and not uncited as g from gr) select count(*) as answers, round(avg(g::int), 4) as rate, count(*) filter (where not g) as ungrounded from z")
def _(t):
    return X.groundedness_rate(X.groundedness(_answers(t)))


TEMPLATES = {"exact_citation": "What does {clause} require about {topic}?", "topic_phrased": "Which provision covers {topic}?", "amendment_history": "How did the rule on {topic} change?"}


@query("k9_retrieval_benchmark", f"""select p_partkey as provision_id, p_partkey % 12 as rule_id, lower(p_type) || '_' || p_partkey % 5 as field, s.style || '-' || p_partkey as query_id, s.style, replace(replace(s.tx, '{{clause}}', 'Rule ' || p_partkey % 30), '{{topic}}', lower(p_type) || ' ' || p_partkey % 5) as text
 from part cross join (values {", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES.items())}) s(style, tx)""")
def _(t):
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("provision_id"), (k % 12).alias("rule_id"), F.concat(F.lower("p_type"), F.lit("_"), (k % 5).cast("string")).alias("field"), F.concat(F.lit("Rule "), (k % 30).cast("string")).alias("clause"))
    return R.retrieval_benchmark(rows, TEMPLATES)
