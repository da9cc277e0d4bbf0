"""Queries of the line and layout operators (survey T1 to T28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import measures as M
from labelwright.functions import patterns as P
from labelwright.functions.patterns import re2
from labelwright.operators import lines as L
from labelwright.plans.registry import query

LABELS = ("label_lines",)


def q(pattern: str) -> str:
    """A pattern as a SQL literal for the twin engine."""
    return "'" + re2(pattern).replace("'", "''") + "'"


@query("t1_to_lines", "select doc_id, n, text from text_lines", ("text_lines",))
def _(t):
    return L.to_lines(t.documents)


@query("t1_to_text", "select doc_id, md5(string_agg(text, chr(10) order by n)) as digest from text_lines group by doc_id", ("text_lines",))
def _(t):
    return L.to_text(t.text_docs.drop("text")).where(F.size("lines") > 0).select("doc_id", F.md5("text").alias("digest"))


@query("t2_page_confidence", "select doc_id, round(avg(confidence), 6) as page_confidence from detections group by doc_id", ("detections",))
def _(t):
    return L.page_confidence(t.label_docs).select("doc_id", F.round("page_confidence", 6).alias("page_confidence"))


@query("t3_match_aliases", "select doc_id, field, n, text, 'literal' as source from lit", ("keywords",))
def _(t):
    return L.match_aliases(t.label_docs)


@query("t4_match_keywords", "select * from kw", ("keywords",))
def _(t):
    return L.match_keywords(t.label_docs)


def _near_sql(keyword: str, value: str, skip: str, extra: str = "") -> str:
    return f"""with k as (select doc_id, min(n) kn from label_lines where regexp_matches(text, {q(keyword)}) group by doc_id),
 c as (select k.doc_id, kn, l.n, regexp_extract(l.text, {q(value)}, 1) as value,
   row_number() over (partition by k.doc_id order by l.n) rn
  from k join label_lines l on l.doc_id = k.doc_id and l.n between kn and kn + 6
  where regexp_matches(l.text, {q(value)}) and (l.n = kn or not regexp_matches(l.text, {q(skip)})))
 select doc_id, kn as keyword_line, n as value_line, trim(value) as value from c where rn = 1 {extra}"""


@query("t5_value_near", _near_sql(r"net\s+(?:quantity|weight)", r"([0-9]+(?:\.[0-9]+)?)\s*(?:kg|g|ml)\b", P.DECLARATION_HEADING), LABELS)
def _(t):
    return L.value_near(t.label_docs, r"net\s+(?:quantity|weight)", r"([0-9]+(?:\.[0-9]+)?)\s*(?:kg|g|ml)\b")


_DATE_SQL = f"""k as (select doc_id, n as kn from label_lines where regexp_matches(text, {q(P.DATE_KEYWORD)})),
 v as (select doc_id, n as vn, text from label_lines where regexp_matches(text, {q(P.DATE_PLAIN)})),
 dn as (select doc_id, n, text from (select k.doc_id, v.vn as n, v.text,
   row_number() over (partition by k.doc_id order by kn, vn <> kn, vn) rn
  from k join v on v.doc_id = k.doc_id and vn between kn - 6 and kn + 6) where rn = 1)"""


@query("t6_date_near", f"with {_DATE_SQL} select doc_id, n, text from dn", LABELS)
def _(t):
    return L.date_near(t.label_docs)


_CONTEXT_SQL = f"""ctx as (select doc_id, n, text, coalesce(lag(h) over w, false) or coalesce(lead(h) over w, false) as near from
  (select *, regexp_matches(text, {q(P.NUTRITION_ROW)}) h from label_lines) window w as (partition by doc_id order by n))"""


@query("t7_exclude_context", f"with {_CONTEXT_SQL} select doc_id, n, text from ctx where not near", LABELS)
def _(t):
    return L.exclude_context(t.label_docs)


_AMT = f"(len(regexp_extract_all(text, {q(P.CURRENCY_AMOUNT)})) > 0 or regexp_matches(text, {q(P.LABELLED_AMOUNT)}))"
_PRICE_SQL = f"""pk as (select doc_id, min(n) kn from label_lines where regexp_matches(text, {q(P.PRICE_LABEL)}) group by doc_id),
 pa as (select pk.doc_id, pk.kn, arg_min(l.text, l.n) as atext from pk join label_lines l on l.doc_id = pk.doc_id
   and l.n between pk.kn + 1 and pk.kn + 6 where {_AMT} or regexp_matches(text, {q(P.BARE_AMOUNT)}) group by 1, 2),
 pl as (select pk.doc_id, case when {_AMT} or a.atext is null then l.text else l.text || ' ' || a.atext end as price
  from pk join label_lines l on l.doc_id = pk.doc_id and l.n = pk.kn left join pa a on a.doc_id = pk.doc_id),
 tx as (select doc_id, arg_min(text, n) as tax from label_lines where regexp_matches(text, {q(P.TAX_WORDING)}) group by doc_id),
 price as (select pl.doc_id, case when not regexp_matches(price, {q(P.TAX_WORDING)}) and tax is not null
   and not contains(price, tax) then price || ' ' || tax else price end as value from pl left join tx on tx.doc_id = pl.doc_id)"""


@query("t8_join_supporting_line", f"with {_PRICE_SQL} select doc_id, value from price", LABELS)
def _(t):
    return L.join_supporting_line(t.label_docs)


def _block_sql(trigger: str) -> str:
    return f"""with k as (select doc_id, min(n) kn from label_lines where regexp_matches(text, {q(trigger)}) group by doc_id),
 w as (select k.doc_id, kn, l.n, l.text, sum(case when l.n > kn and regexp_matches(l.text, {q(P.DECLARATION_HEADING)})
    and not regexp_matches(l.text, {q(trigger)}) then 1 else 0 end) over (partition by k.doc_id order by l.n) stops
  from k join label_lines l on l.doc_id = k.doc_id and l.n between kn and kn + 8)
 select doc_id, kn as start_line, cast(count(*) as int) as n_lines, string_agg(text, chr(10) order by n) as block from w where stops = 0 group by doc_id, kn"""


@query("t9_block_after", _block_sql(P.INGREDIENTS_TRIGGER), LABELS)
def _(t):
    return L.block_after(t.label_docs)


@query("t9_nutrition_block", _block_sql(P.NUTRITION_TRIGGER), LABELS)
def _(t):
    return L.block_after(t.label_docs, P.NUTRITION_TRIGGER)


_CARE_SQL = f"""ck as (select doc_id, min(n) kn from label_lines where regexp_matches(text, {q(P.CARE_TRIGGER)}) group by doc_id),
 cw as (select ck.doc_id, kn, l.n, l.text, sum(case when l.n > kn and regexp_matches(l.text, {q(P.CARE_STOP)}) then 1 else 0 end)
    over (partition by ck.doc_id order by l.n) stops
  from ck join label_lines l on l.doc_id = ck.doc_id and l.n between kn and kn + 3),
 cb as (select doc_id, kn, string_agg(text, chr(10) order by n) as block from cw where stops = 0
   and (n = kn or not regexp_matches(text, {q(P.BARE_FRAGMENT)})) group by doc_id, kn)"""


@query("t10_care_block", f"with {_CARE_SQL} select doc_id, kn as start_line, block from cb", LABELS)
def _(t):
    return L.care_block(t.label_docs)


_NOISE = (f"(length(text) <= 3 or regexp_matches(text, {q(P.BARE_FRAGMENT)}) or regexp_matches(text, {q(P.BARE_NUMBER)}) "
          f"or regexp_matches(text, {q(P.DECLARATION_HEADING)}))")


def _continuation_ctes(heads: str) -> str:
    """``heads`` has (doc_id, kn). First content line, then further lines while the last one ends with a comma."""
    return f"""w as (select h.doc_id, h.kn, l.n, l.text, {_NOISE} as noise from ({heads}) h
   join label_lines l on l.doc_id = h.doc_id and l.n between kn + 1 and kn + 6),
 f as (select doc_id, kn, min(n) fn from w where not noise group by 1, 2),
 x as (select w.*, w.n - f.fn as off, max(case when w.noise or (w.n > f.fn and not p.text like '%,') or w.n - f.fn >= 4 then 1 else 0 end)
    over (partition by w.doc_id, w.kn order by w.n) as ended
  from w join f using (doc_id, kn) left join label_lines p on p.doc_id = w.doc_id and p.n = w.n - 1 where w.n >= f.fn),
 cont as (select doc_id, kn, string_agg(text, ' ' order by n) as value from x where ended = 0 group by 1, 2)"""


_HEADS = f"select doc_id, min(n) kn from label_lines where regexp_matches(text, {q(P.HEADING_ONLY)}) group by doc_id"


@query("t11_continuation", f"""with {_continuation_ctes(_HEADS)}
 select h.doc_id, h.kn as start_line, coalesce(value, '') as value from ({_HEADS}) h left join cont using (doc_id, kn)""", LABELS)
def _(t):
    return L.continuation(t.label_docs)


@query("t12_spatial_continuation")
def _(t):
    return L.spatial_continuation(t.label_docs)


def _roles_sql() -> str:
    """Claims roles one after another: a line taken by an earlier role is skipped."""
    ctes, claimed = [], []
    for role, pattern in P.ROLE_HEADINGS.items():
        taken = " and ".join(f"not exists (select 1 from r_{c} c where c.doc_id = l.doc_id and c.n = l.n)" for c in claimed) or "true"
        ctes.append(f"r_{role} as (select doc_id, min(n) n from label_lines l where regexp_matches(text, {q(pattern)}) and {taken} group by doc_id)")
        claimed.append(role)
    union = " union all ".join(f"select doc_id, n, '{r}' as role from r_{r}" for r in claimed)
    heads = f"select r.doc_id, r.n as kn from rl r join label_lines l on l.doc_id = r.doc_id and l.n = r.n where regexp_matches(l.text, {q(P.HEADING_ONLY)})"
    return (", ".join(ctes) + f", rl as ({union}), " + _continuation_ctes(heads)
            + """, roles as (select rl.doc_id, rl.n, rl.role, case when coalesce(cont.value, '') = '' then l.text else l.text || ' ' || cont.value end as value
   from rl join label_lines l on l.doc_id = rl.doc_id and l.n = rl.n left join cont on cont.doc_id = rl.doc_id and cont.kn = rl.n)""")


@query("t13_role_declarations", f"with {_roles_sql()} select doc_id, n, role, value from roles", LABELS)
def _(t):
    return L.role_declarations(t.label_docs)


@query("t13_role_declarations_by_layout")
def _(t):
    return L.role_declarations(t.label_docs, use_layout=True)


@query("t14_heading_only", f"with {_roles_sql()} select doc_id, n, role, regexp_matches(value, {q(P.HEADING_ONLY)}) as heading_only from roles", LABELS)
def _(t):
    return L.heading_only(t.label_docs)


@query("t15_paired_heading", f"""select doc_id, cast(first_line as int) first_line, cast(second_line as int) second_line from (
 select a.doc_id, a.n as first_line, b.n as second_line, row_number() over (partition by a.doc_id order by a.n, b.n) rn
 from label_lines a join label_lines b on b.doc_id = a.doc_id and b.n between a.n + 1 and a.n + 4
 where regexp_matches(a.text, {q(P.CARE_SPLIT_FIRST)}) and regexp_matches(b.text, {q(P.CARE_SPLIT_SECOND)})) where rn = 1""", LABELS)
def _(t):
    return L.paired_heading(t.label_docs)


_PHONE_OK = "(regexp_matches(p, '[\\s\\-]') or length(regexp_replace(p, '[^0-9]', '', 'g')) <= 11)"
_CONTACT_SQL = f"""cl as (select ck.doc_id, ck.kn, l.n, l.text from ck join label_lines l on l.doc_id = ck.doc_id and l.n between kn and kn + 11),
 ph as (select doc_id, arg_min(p, n * 1000 + i) as phone from (select doc_id, n, unnest(ps) as p, generate_subscripts(ps, 1) as i from
   (select doc_id, n, regexp_extract_all(text, {q(P.PHONE)}) as ps from cl)) where {_PHONE_OK} group by doc_id),
 em as (select doc_id, arg_min(regexp_extract(text, {q(P.EMAIL)}, 0), n) as email from cl where regexp_matches(text, {q(P.EMAIL)}) group by doc_id)"""


@query("t16_contacts", f"""with {_CARE_SQL}, {_CONTACT_SQL} select ck.doc_id, ck.kn as start_line, phone as telephone_number, email as email_address
 from ck left join ph using (doc_id) left join em using (doc_id)""", LABELS)
def _(t):
    return L.contacts(t.label_docs)


@query("t16_contacts_by_layout")
def _(t):
    return L.contacts(t.label_docs, use_layout=True)


@query("t17_contact_name", f"""with {_CARE_SQL} select doc_id, name, nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(
   case when name is not null and starts_with(lower(block), lower(name)) then substr(block, length(name) + 1) else block end,
   {q(P.CARE_LEAD_IN)}, '', 'g'), ' :-' || chr(10)), {q(P.PHONE)}, '', 'g'), {q(P.EMAIL)}, '', 'g'), ' :-' || chr(10)), '') as address
 from (select doc_id, block, nullif(list_aggregate(list_transform(string_split(regexp_extract(split_part(block, chr(10), 1), {q(P.CARE_NAME)}, 0), ' '),
   lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '), '') as name from cb)""", LABELS)
def _(t):
    return L.contact_name(t.label_docs)


@query("t18_amounts", f"""select doc_id, n, ord - 1 as ord, amount from (select doc_id, n, unnest(a) as amount, generate_subscripts(a, 1) as ord from (
 select doc_id, n, case when len(regexp_extract_all(text, {q(P.CURRENCY_AMOUNT)}, 1)) > 0 then regexp_extract_all(text, {q(P.CURRENCY_AMOUNT)}, 1)
  when regexp_matches(text, {q(P.LABELLED_AMOUNT)}) then [regexp_extract(text, {q(P.LABELLED_AMOUNT)}, 1)] else [] end as a from label_lines))""", LABELS)
def _(t):
    return L.line_amounts(t.label_docs)


_QTY = f"""(cast(regexp_extract(text, {q(P.QUANTITY)}, 1) as double) *
  case when lower(regexp_extract(text, {q(P.QUANTITY)}, 2)) in ('kg','kgs','kilogram','kilograms','l','litre','litres','liter','liters') then 1000 else 1 end)"""
_BASIS = f"case when lower(regexp_extract(text, {q(P.QUANTITY)}, 2)) in ('kg','kgs','kilogram','kilograms','g','gm','gms','gram','grams') then 'weight' else 'volume' end"


@query("t19_quantity", f"select doc_id, n, {_QTY} as amount, {_BASIS} as basis from label_lines where regexp_matches(text, {q(P.QUANTITY)})", LABELS)
def _(t):
    return L.line_quantities(t.label_docs)


@query("t19_quantity_coverage", f"""select source as grp, cast(sum(case when regexp_matches(l.text, '[0-9]') then 1 else 0 end) as bigint) as shaped,
 cast(sum(case when regexp_matches(l.text, {q(P.QUANTITY)}) then 1 else 0 end) as bigint) as parsed,
 cast(sum(case when regexp_matches(l.text, '[0-9]') and not regexp_matches(l.text, {q(P.QUANTITY)}) then 1 else 0 end) as bigint) as unparsed
 from documents d join text_lines l on l.doc_id = d.doc_id group by source""", ("text_lines",))
def _(t):
    return L.coverage(t.text_docs.where(F.size("lines") > 0), M.quantity_amount, F.col("source"), "[0-9]")


_COUNTS = "|".join(P.PACKAGE_COUNT)


@query("t20_package_count", f"""select doc_id, n, cast(coalesce(nullif(regexp_extract(text, {q(_COUNTS)}, 1), ''),
 nullif(regexp_extract(text, {q(_COUNTS)}, 2), ''), nullif(regexp_extract(text, {q(_COUNTS)}, 3), '')) as int) as packages
 from label_lines where regexp_matches(text, {q(_COUNTS)})""", LABELS)
def _(t):
    return L.line_package_counts(t.label_docs)


@query("t21_unit_price", f"""select doc_id, n, cast(regexp_extract(text, {q(P.UNIT_PRICE)}, 1) as double) as amount, lower(regexp_extract(text, {q(P.UNIT_PRICE)}, 2)) as unit
 from label_lines where regexp_matches(text, {q(P.UNIT_PRICE)})""", LABELS)
def _(t):
    return L.line_unit_prices(t.label_docs)


_YM = f"""(select *, case when len(parts) in (2, 3) then try_cast(parts[-2] as int) end as mm, try_cast(parts[-1] as int) as yy from
   (select doc_id, n, text, string_split_regex(regexp_extract(text, {q(P.DATE_PLAIN)}, 0), '[/\\-.]') as parts
    from %s where regexp_matches(text, {q(P.DATE_PLAIN)})))"""


@query("t22_month_year", f"""select doc_id, n, (case when yy < 100 then yy + 2000 else yy end) * 100 + mm as year_month
 from {_YM % 'label_lines'} where mm between 1 and 12""", LABELS)
def _(t):
    return L.line_months(t.label_docs)


@query("t23_future_date_check", f"""with {_DATE_SQL} select doc_id, yy * 100 + mm as year_month,
 case when yy * 100 + mm > 202606 then 'NEEDS_MANUAL_VERIFICATION' else 'PASS' end as status from {_YM % 'dn'}""", LABELS)
def _(t):
    return L.future_date_check(t.label_docs, 2026, 6)


_COUNTRY_SQL = f"""{_CONTEXT_SQL},
 cn as (select k.doc_id, k.text, arg_min(c.text, c.n) as word from kw k left join ctx c on c.doc_id = k.doc_id and c.n between k.n + 1 and k.n + 6
   and not c.near and regexp_matches(c.text, {q(P.COUNTRY_WORD)}) and not regexp_matches(c.text, {q(P.NUTRITION_ROW)})
  where k.field = 'country_of_origin' group by 1, 2),
 cj as (select doc_id, case when trim(regexp_replace(text, {q(P.COUNTRY_KEYWORD)}, '', 'g'), ' :-') = '' and word is not null
   then text || ' ' || word else text end as v from cn),
 country as (select doc_id, case when regexp_matches(v, {q(P.MADE_IN)}) then 'MADE IN ' || upper(regexp_extract(v, {q(P.MADE_IN)}, 1)) else v end as country from cj)"""


@query("t24_country", f"with {_COUNTRY_SQL} select doc_id, country from country", ("keywords",))
def _(t):
    return L.country(t.label_docs)


@query("t25_spatial_pair", f"""with m as (select * from detections where regexp_matches(text, {q(P.MADE_IN_MARKER)})),
 c as (select m.doc_id, m.pos as marker_pos, d.pos as value_pos, 'MADE IN ' || upper(d.text) as value, round((m.confidence + d.confidence) / 2, 4) as confidence,
  row_number() over (partition by m.doc_id order by m.pos, d.y1 - m.y2, d.pos) rn from m join detections d on d.doc_id = m.doc_id and d.pos <> m.pos
  where regexp_matches(d.text, {q(P.COUNTRY_WORD)}) and not regexp_matches(d.text, {q(P.NUTRITION_ROW)}) and d.y1 >= m.y1
   and d.y1 <= m.y2 + greatest(80, 4 * (m.y2 - m.y1)) and greatest(0, least(m.x2, d.x2) - greatest(m.x1, d.x1)) >= 0.35 * least(m.x2 - m.x1, d.x2 - d.x1))
 select doc_id, marker_pos, value_pos, value, confidence from c where rn = 1""", ("detections",))
def _(t):
    return L.spatial_pair(t.label_docs)


_DESCRIPTIVE = (f"regexp_matches(%s, {q(P.COMMODITY_NOUN)}) and not contains(%s, ',') and length(%s) <= 40 "
                f"and not regexp_matches(%s, {q(P.SERVING_SIZE)}) and not regexp_matches(%s, {q(P.BUSINESS_ENTITY)})")


def _descriptive(col: str) -> str:
    return _DESCRIPTIVE % ((col,) * 5)


@query("t26_identity_candidate", f"""with {_CONTEXT_SQL}, c as (select doc_id, n, text, row_number() over (partition by doc_id order by
   case when len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w not in ('a','b','c'))) > 1 then 0 else 1 end, n) rn
  from ctx where not near and {_descriptive('text')} and not regexp_matches(text, {q(P.DECLARATION_HEADING)})
   and not regexp_matches(text, {q(P.BARE_NUMBER)}) and not regexp_matches(text, {q(P.NUTRITION_ROW)}))
 select doc_id, n, text from c where rn = 1""", LABELS)
def _(t):
    return L.identity_candidate(t.label_docs)


@query("t27_enumerated_components")
def _(t):
    return L.enumerated_components(t.label_docs)


@query("t28_licence_numbers", f"""select doc_id, value from (select doc_id, regexp_extract(string_agg(text, chr(10) order by n), {q(P.LICENCE)}, 1) as value
 from label_lines group by doc_id) where value <> ''""", LABELS)
def _(t):
    return L.licence_numbers(t.label_docs)


@query("t28_barcode_lines", f"select doc_id, arg_min(text, n) as value from label_lines where regexp_matches(text, {q(P.BARCODE_LINE)}) group by doc_id", LABELS)
def _(t):
    return L.barcode_lines(t.label_docs)


@query("t28_batch_numbers", _near_sql(P.BATCH_KEYWORD, P.BATCH_VALUE, P.DECLARATION_HEADING, "and regexp_matches(value, '[0-9]')"), LABELS)
def _(t):
    return L.batch_numbers(t.label_docs)


@query("t28_expiry_dates", _near_sql(P.EXPIRY_KEYWORD, P.EXPIRY_VALUE, P.DECLARATION_HEADING), LABELS)
def _(t):
    return L.expiry_dates(t.label_docs)


@query("t28_warning_lines", f"""select doc_id, row_number() over (partition by doc_id order by n) - 1 as ord, text as warning from
 (select doc_id, text, min(n) n from label_lines where regexp_matches(text, {q(P.WARNING)}) group by 1, 2)""", LABELS)
def _(t):
    return L.warning_lines(t.label_docs)
