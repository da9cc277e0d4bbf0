"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from labelwright.llm import mixing, url_filter, vector_codes


def _word(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::int"


def url_sql() -> str:
    weight = " + ".join(f"{w} * {_word(t)}" for t, w in sorted(url_filter.SOFT.items()))
    terms = " + ".join(_word(t) for t in url_filter.SOFT)
    hits = " + ".join(f"len(regexp_extract_all(regexp_replace(u, '[^a-z0-9]+', '  ', 'g'), '(^| ){t}( |$)'))" for t in url_filter.STRICT)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return f"""
with cut as (select page_id, url, translate(coalesce(url, ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as u,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
numbered as (select *, row_number() over () as rn from cut),
rules(h, p, v) as (values {rules}),
fit as (select rn, h || p as rule, v, row_number() over (partition by rn order by length(h || p) desc, h || p) as k
    from numbered join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
judged as (select *, {hits} as strict_hits, {terms} as soft_terms, {weight} as soft_weight from numbered)
select page_id, host, path, rule, coalesce(v, case when strict_hits > 0 or soft_weight >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end) as verdict,
    cast(strict_hits as int) as strict_hits, cast(soft_terms as int) as soft_terms, cast(soft_weight as double) as soft_weight
from judged left join (select * from fit where k = 1) using (rn)"""


WORD = r"[^\x20\x09-\x0D]+"
MIX = rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, len(regexp_extract_all(coalesce(text, ''), '{mixing.NOISE}'))::double as noise from documents),
keyed as (select *, -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
    / (case when size > 0 then size / (size + 4.0::double * least(noise, size::double)) else 1.0 end) as k from sized),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [{", ".join(f"{w}::double" for w in mixing.WEIGHTS)}][1 + (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}] as w, {mixing.MOST}::double * source_size as cap from sources),
running as (select *, cap / w as ratio, coalesce(sum(cap) over before, 0) as filled, sum(w) over () - coalesce(sum(w) over before, 0) as rest_w, {mixing.SHARE}::double * sum(source_size) over () as whole
    from weighed window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
leveled as (select *, max(case when ratio >= (whole - filled) / rest_w then (whole - filled) / rest_w end) over () as level from running),
targets as (select source, source_size, case when level is null or ratio <= level then cap else level * w end as target from leveled),
run as (select k.doc_id, k.size, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint as epochs,
    coalesce(sum(k.size) over (partition by k.source order by k.k, k.doc_id nulls first, k.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from keyed k join targets t on k.source is not distinct from t.source)
select doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, round(target)::bigint - epochs * source_size - before)))::bigint as taken from run"""

KTOP = """
with points as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
    from points q join points c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5"""

def _then(state: str, cost: str, letter: str) -> str:
    """A state is its cost in twelve digits and its edits so far, so that the least text is the cheapest, then the ASCII-least."""
    return f"lpad((left({state}, 12)::bigint + {cost})::varchar, 12, '0') || substr({state}, 13) || '{letter}'"


def repair_sql() -> str:
    insert = lambda x: _then(x, "2", "I")
    relaxed = f"select cid, i, s0, s1, n2, least(s3, {insert('n2')}) as n3 from (select *, least(s2, {insert('s0')}, {insert('s1')}, {insert('s3')}) as n2 from {{0}})"
    drop = lambda x: _then(x, "3", "D")
    user, other = (f"case when r.initial = '{c}' then " for c in "ua")
    put = lambda head, x: f"{head} {_then(x, 'r.cut', 'K')} else {_then(x, '2 + r.cut', 'R')} end"
    may = lambda x: f"case when not r.forced then {x} end"
    return rf"""
with recursive crcs as (select list_transform(range(256), lambda i: list_reduce([i::bigint] || list_transform(range(8), lambda k: 0::bigint), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as t),
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
hashed as (select *, xor(list_reduce([4294967295::bigint] || list_transform(string_split(name, ''), lambda c: ascii(c)::bigint), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 as hit from given, crcs),
damaged as (select coalesce('=' || conv_id::varchar, '') as cid, conv_id, turn, case when hit = 4 then 'user' else role end as role,
    case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, hit, unnest(case when hit = 3 then [1, 2] else [1] end) as copy from hashed),
rows_ as (select *, row_number() over (partition by cid order by turn nulls first, role, md5(text), copy) as place, left(role, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ended,
    row_number() over (partition by cid, role, text order by turn nulls first, copy) as time from damaged where hit <> 0),
faults as (select *, ended = '' as blank, ended <> '' and time > 1 as duplicate, ended <> '' and time = 1 and right(ended, 1) not in ('.', '!', '?') as truncated,
    lag(initial) over (partition by cid order by place) || initial not in ('su', 'ua', 'au') as illegal from rows_),
r as (select *, blank or duplicate as forced, truncated::int as cut from faults),
convs as (select cid, any_value(conv_id) as conv_id from damaged group by cid),
counts as (select cid, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (illegal) as illegal, count(*) as n from r group by cid),
states(cid, i, s0, s1, s2, s3) as (select cid, 0::bigint, '000000000000', null::varchar, null::varchar, null::varchar from convs
    union all select x.cid, x.i + 1, {drop("x.s0")}, least({drop("x.s1")}, case when not r.forced and r.initial = 's' then {_then("x.s0", "r.cut", "K")} end),
        least({drop("x.n2")}, {", ".join(may(put(user, x)) for x in ("x.s0", "x.s1", "x.n3"))}), least({drop("x.n3")}, {may(put(other, "x.n2"))})
    from ({relaxed.format("states")}) x join r on r.cid = x.cid and r.place = x.i + 1),
ended as (select cid, least(s0, n3) as best from ({relaxed.format("states")}) x left join counts using (cid) where i = coalesce(n, 0)),
audits as (select cid, left(best, 12)::bigint as cost, substr(best, 13) as audit from ended),
letters as (select cid, audit[k] as letter, len(replace(left(audit, k), 'I', '')) as place, len(replace(left(audit, k), 'D', '')) as turn_no from (select cid, audit, unnest(range(1, len(audit) + 1)) as k from audits)),
said as (select l.cid, l.turn_no, l.letter, r.role, r.text, max((l.letter = 'K' and r.initial = 's')::int) over (partition by l.cid) as headed from letters l left join r on r.cid = l.cid and r.place = l.place and l.letter <> 'I'
    where l.letter <> 'D'),
repaired as (select cid, string_agg(case when letter = 'K' then role when (turn_no - headed) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end, chr(10) order by turn_no) as whole from said group by cid)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
    cost, audit, sha256(coalesce(whole, '')) as repaired_sha256
from convs join audits using (cid) left join counts using (cid) left join repaired using (cid)"""


def codes_sql() -> str:
    n = vector_codes.PARTS
    apart = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    rounds = ""
    for k in range(vector_codes.ROUNDS + 1):
        rounds += f"""
at{k} as materialized (select rid, p, min({{d: d, e: e}}) as best from (select a.rid, a.p, b.e, {apart} as d from cut a join book{k} b on a.p = b.p) group by rid, p),"""
        if k < vector_codes.ROUNDS:
            rounds += f"""
sums{k} as (select p, e, i, sum(v)::bigint as total, count(*) as n from (select a.p, t.best.e as e, unnest(a.x) as v, unnest(range(len(a.x))) as i from cut a join at{k} t on a.rid = t.rid and a.p = t.p) group by p, e, i),
moved{k} as (select p, e, list((total - ((total % n) + n) % n) // n order by i) as x from sums{k} group by p, e),
book{k + 1} as materialized (select b.p, b.e, coalesce(m.x, b.x) as x from book{k} b left join moved{k} m on b.p = m.p and b.e = m.e),"""
    last = vector_codes.ROUNDS
    return f"""
with whole as (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as materialized (select rid, p, v[p * (len(v) // {n}) + 1 : (p + 1) * (len(v) // {n})] as x from (select rid, v, unnest(range({n})) as p from whole)),
first as (select rid, row_number() over (order by vec_id) - 1 as e from (select vec_id, min({{v: v, rid: rid}}).rid as rid from whole where vec_id is not null group by vec_id order by vec_id limit {vector_codes.ENTRIES})),
book0 as materialized (select p, e, x from cut join first using (rid)),{rounds}
coded as (select rid, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.d)::bigint as error from at{last} group by rid),
digest as (select sha256(string_agg(v::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(x) as v, unnest(range(len(x))) as i from book{last}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from whole join coded using (rid), digest"""


ORACLES = {"op6_mix_sources": MIX, "op8_top_k": KTOP, "op10_url_filter": url_sql(), "op11_repair_conversations": repair_sql(), "op12_vector_codes": codes_sql()}
