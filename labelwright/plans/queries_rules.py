"""Queries of the condition language, rule evaluation, lookups and lot calculations (survey R, J7 to J9, C1 to C7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions.text import group
from labelwright.operators import lookups as K
from labelwright.operators import lots as C
from labelwright.operators import rules as R
from labelwright.plans.queries_lines import q
from labelwright.plans.reference_tables import RULESET, sql_values, table
from labelwright.plans.registry import query
from labelwright.plans.views import FACTS

WIDE = ("wide_facts",)


def tri(expr: str) -> str:
    return f"case when ({expr}) is null then 'UNKNOWN' when ({expr}) then 'TRUE' else 'FALSE' end"


def known(key: str, expr: str) -> str:
    return f"case when k_{key} then {expr} end"


def conditions(name: str, cases: dict[str, tuple[dict, str]]):
    """Register one query that evaluates each condition on every document, next to its SQL truth."""
    sql = "select doc_id, " + ", ".join(f"{tri(expr)} as {label}" for label, (_c, expr) in cases.items()) + " from wide_facts"

    def run(t):
        wide = R.widen_facts(t.view("facts"), R.paths_in([c for c, _e in cases.values()]))
        return wide.select("doc_id", *[R.truth_name(R.compile_condition(c).truth).alias(label) for label, (c, _e) in cases.items()])
    query(name, sql, WIDE)(run)


def leaf(path: str, op: str, value=None, **more) -> dict:
    return {"field": path, "op": op, "value": value, **more}


conditions("r1_exists", {
    "commodity": (leaf("package.commodity", "exists"), known("commodity", "v_commodity is not null")),
    "no_commodity": (leaf("package.commodity", "not_exists"), known("commodity", "v_commodity is null")),
    "quantity": (leaf("package.net_quantity_value", "exists"), known("net_quantity_value", "true"))})
conditions("r2_equality", {
    "packer": (leaf("entity.role", "eq", "packer"), known("role", "v_role = 'packer'")),
    "any_role": (leaf("entity.role", "eq", ["packer", "importer"]), known("role", "v_role in ('packer', 'importer')")),
    "not_grams": (leaf("package.net_quantity_unit", "ne", "g"), "v_net_quantity_unit <> 'g'"),
    "export": (leaf("package.is_export", "eq", True), known("is_export", "v_is_export")),
    "bool_is_no_number": (leaf("package.is_export", "eq", 1), known("is_export", "false")),
    "eleven": (leaf("package.net_quantity_value", "eq", 11), known("net_quantity_value", "v_net_quantity_value = 11")),
    "null_value": (leaf("package.commodity", "eq", "small ring"), known("commodity", "coalesce(v_commodity = 'small ring', false)"))})
conditions("r3_ordering", {
    "price": (leaf("label.mrp_value", "gt", 1000), "v_mrp_value > 1000"), "small": (leaf("package.net_quantity_value", "lte", 20), "v_net_quantity_value <= 20"),
    "text": (leaf("package.commodity", "gte", 5), "null::boolean"), "flag": (leaf("package.is_export", "lt", 5), "null::boolean")})
conditions("r4_membership", {
    "role": (leaf("entity.role", "in", ["packer", "importer"]), known("role", "v_role in ('packer', 'importer')")),
    "commodity": (leaf("package.commodity", "not_in", ["small ring"]), known("commodity", "coalesce(v_commodity <> 'small ring', true)")),
    "no_list": (leaf("entity.role", "in", "packer"), "null::boolean")})
conditions("r5_matches", {
    "wording": (leaf("label.mrp_text", "matches", "Inclusive of"), "regexp_matches(v_mrp_text, 'Inclusive of')"),
    "number": (leaf("label.mrp_value", "matches", "9"), "null::boolean")})
conditions("r6_contains", {
    "text": (leaf("label.mrp_text", "contains", "INCLUSIVE"), "contains(lower(v_mrp_text), 'inclusive')"),
    "list": (leaf("label.claims", "contains", "ECONOMY"), "list_contains(v_claims, 'ECONOMY')"),
    "number": (leaf("label.mrp_value", "contains", "9"), known("mrp_value", "false"))})
conditions("r7_contains_any", {
    "text": (leaf("package.commodity", "contains_any", ["Ring", "bolt"]), known("commodity", "coalesce(contains(lower(v_commodity), 'ring') or contains(lower(v_commodity), 'bolt'), false)")),
    "none": (leaf("package.commodity", "not_contains_any", ["ring", "bolt"]), known("commodity", "not coalesce(contains(lower(v_commodity), 'ring') or contains(lower(v_commodity), 'bolt'), false)")),
    "list": (leaf("label.claims", "contains_any", ["ECONOMY", "x"]), "list_contains(v_claims, 'ECONOMY')")})
conditions("r8_between", {
    "size": (leaf("package.net_quantity_value", "between", [10, 20]), "v_net_quantity_value between 10 and 20"),
    "text": (leaf("package.commodity", "between", [1, 2]), "null::boolean")})
_A, _B, _Cc = leaf("label.mrp_value", "gt", 1000), leaf("package.net_quantity_value", "lte", 20), leaf("entity.role", "eq", "packer")
_a, _b, _c = "v_mrp_value > 1000", "v_net_quantity_value <= 20", "case when k_role then v_role = 'packer' end"
conditions("r9_combinators", {
    "all_of": ({"all": [_A, _B, _Cc]}, f"({_a}) and ({_b}) and ({_c})"), "any_of": ({"any": [_A, _B, _Cc]}, f"({_a}) or ({_b}) or ({_c})"),
    "none_of": ({"not": {"any": [_A, _B]}}, f"not (({_a}) or ({_b}))"), "mixed": ({"all": [{"not": _A}, {"any": [_B, _Cc]}]}, f"(not ({_a})) and (({_b}) or ({_c}))")})
conditions("r10_fact_reference", {
    "sale": (leaf("sale.price", "lte", value_from="label.mrp_value"), "v_price <= v_mrp_value"),
    "same": (leaf("label.country_of_origin", "ne", value_from="package.commodity"), "case when k_country_of_origin and k_commodity then coalesce(v_country_of_origin <> v_commodity, true) end")})
conditions("r11_scaled_reference", {
    "sale": (leaf("sale.price", "gt", value_from="1.5 x label.mrp_value"), "v_price > 1.5 * v_mrp_value"),
    "text": (leaf("sale.price", "gt", value_from="2 x package.commodity"), "null::boolean")})

_CANONICAL_SQL = "case when k_net_quantity_basis then v_net_quantity_value * case v_net_quantity_unit when 'kg' then 1.0 else 0.001 end end"
_UNITS_SQL = f"""um as (select w.*, case when q < 1 then [unit_below] when q = 1 then [unit_below, unit_from] when q > 1 then [unit_from] end as allowed
  from (select *, {_CANONICAL_SQL} as q from wide_facts) w left join {sql_values("units_by_magnitude", ["basis", "unit_below", "unit_from"])} on basis = v_net_quantity_basis)"""


def quantity_facts(t):
    """Quantity, unit and basis per document from the long facts, with the canonical quantity."""
    wide = R.widen_facts(t.view("facts"), {"package.net_quantity_value", "package.net_quantity_unit", "package.net_quantity_basis"})
    part = lambda key, v: F.col(R.column_of(f"package.{key}"))[v]
    return R.normalised_quantities(wide.select("doc_id", part("net_quantity_value", "v_num").alias("value"),
                                               part("net_quantity_unit", "v_str").alias("unit"), part("net_quantity_basis", "v_str").alias("basis")))


def wide_with_units(t, ruleset: dict):
    """Widened facts with the allowed units of the document, looked up once."""
    allowed = K.magnitude_units(quantity_facts(t), table(t.spark, "units_by_magnitude"))
    return R.widen_facts(t.view("facts"), R.ruleset_paths(ruleset)).join(allowed, "doc_id", "left")


def lookup_columns() -> dict:
    return {"units_by_magnitude": R.fact(F.col("allowed_units"), v_arr=F.col("allowed_units"))}


@query("r12_lookup_reference", f"""with {_UNITS_SQL} select doc_id, {tri("case when allowed is not null then list_contains(allowed, v_net_quantity_unit) end")} as unit_allowed from um""", WIDE)
def _(t):
    rule = {"rules": [{"id": "unit", "check": leaf("package.net_quantity_unit", "eq", value_from="lookup_tables.units_by_magnitude")}]}
    out = wide_with_units(t, rule)
    return out.select("doc_id", R.truth_name(R.compile_condition(rule["rules"][0]["check"], lookup_columns()).truth).alias("unit_allowed"))


_GENERAL = "(v_is_export and case when k_commodity then v_commodity is not null end and v_net_quantity_unit <> 'kg')"
_RETAIL_EXEMPT = "(v_net_quantity_value <= 5 and not case when k_commodity then coalesce(contains(v_commodity, 'ring'), false) end)"
_RETAIL = f"case when not k_package_type then null when v_package_type = 'wholesale' then false else not {_RETAIL_EXEMPT} end"


@query("r13_exemption_gate", f"select doc_id, {tri(_GENERAL)} as general, {tri(_RETAIL_EXEMPT)} as retail from wide_facts", WIDE)
def _(t):
    gates = RULESET["applicability"]
    wide = R.widen_facts(t.view("facts"), R.paths_in(gates))
    return wide.select("doc_id", R.truth_name(R.compile_exemptions(gates["general_exemptions"]).truth).alias("general"),
                       R.truth_name(R.compile_exemptions(gates["retail_exemptions"]).truth).alias("retail"))


@query("r14_retail_scope", f"select doc_id, {tri(_RETAIL)} as scope from wide_facts", WIDE)
def _(t):
    gates = RULESET["applicability"]
    wide = R.widen_facts(t.view("facts"), R.ruleset_paths(gates))
    return wide.select("doc_id", R.truth_name(R.retail_scope(R.compile_exemptions(gates["retail_exemptions"]).truth)).alias("scope"))


@query("r15_actor_scope", f"""select doc_id, {tri("case when k_role then v_role in ('importer', 'packer') end")} as scope from wide_facts""", WIDE)
def _(t):
    wide = R.widen_facts(t.view("facts"), {"entity.role"})
    return wide.select("doc_id", R.truth_name(R.actor_scope(["importer", "packer"])).alias("scope"))


_RULE_SQL = {
    "price_stated": (f"({_RETAIL}) and not {_GENERAL}", "case when k_mrp_text then true end and v_mrp_value > 0"),
    "price_tax_wording": (f"({_RETAIL}) and not {_GENERAL} and case when k_mrp_text then true end", "v_mrp_inclusive_of_taxes_wording"),
    "sale_not_above_price": (f"not {_GENERAL}", "v_price <= v_mrp_value"),
    "origin_stated": (f"not {_GENERAL} and not case when k_role then v_role = 'packer' end", "case when k_country_of_origin then true end or list_contains(v_claims, 'ECONOMY')"),
    "role_for_import": (f"not {_GENERAL} and case when k_role then v_role in ('importer', 'packer') end", "regexp_matches(v_country_of_origin, 'NATION_1')"),
    "unit_by_magnitude": (f"({_RETAIL}) and not {_GENERAL}", "case when allowed is not null then list_contains(allowed, v_net_quantity_unit) end"),
    "commodity_allowed": (f"not {_GENERAL}", "case when k_commodity then not coalesce(contains(v_commodity, 'widget') or contains(v_commodity, 'gizmo'), false) end"),
    "manual_inspection": (f"({_RETAIL}) and not {_GENERAL}", None),
}


def _rules_sql() -> str:
    parts = []
    for rule, (scope, check) in _RULE_SQL.items():
        tail = "'NOT_ASSESSED'" if check is None else f"case when sc is null or ck is null then 'REVIEW_REQUIRED' when ck then 'PASS' else 'FAIL' end"
        parts.append(f"select doc_id, '{rule}' as rule_id, {tri('sc')} as applicability, case when not sc then 'NOT_APPLICABLE' else {tail} end as status, {'false' if check is None else 'true'} as has_check "
                     f"from (select doc_id, ({scope}) as sc, ({check or 'null::boolean'}) as ck from um)")
    return f"{_UNITS_SQL}, rule_results as ({' union all '.join(parts)})"


RULES_SQL = _rules_sql()


def rule_results(t):
    return R.evaluate_wide(wide_with_units(t, RULESET), RULESET, lookup_columns())


@query("j7_evaluate_rules", f"with {RULES_SQL} select doc_id, rule_id, applicability, status, has_check from rule_results", WIDE)
def _(t):
    return rule_results(t).select("doc_id", "rule_id", "applicability", "status", "has_check")


@query("r16_rule_status", f"with {RULES_SQL} select rule_id, status, count(*) as n from rule_results group by 1, 2", WIDE)
def _(t):
    return rule_results(t).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


_TAX_RULE = {"rules": [{"id": "tax", "check": {"all": [leaf("label.mrp_text", "exists"), leaf("label.mrp_inclusive_of_taxes_wording", "eq", True)]}}]}


@query("r17_trace", f"""select doc_id, 'tax' as rule_id, 'tax.check.all[0]' as path, 'label.mrp_text' as field, 'exists' as operator, case when k_mrp_text then v_mrp_text else 'UNKNOWN' end as actual, 'None' as expected, {tri("case when k_mrp_text then true end")} as result from wide_facts
 union all select doc_id, 'tax', 'tax.check.all[1]', 'label.mrp_inclusive_of_taxes_wording', 'eq', case when k_mrp_inclusive_of_taxes_wording then v_mrp_inclusive_of_taxes_wording::varchar else 'UNKNOWN' end, 'True', {tri("v_mrp_inclusive_of_taxes_wording")} from wide_facts
 union all select doc_id, 'tax', 'tax.check', null, 'all', null, '', {tri("case when k_mrp_text then true end and v_mrp_inclusive_of_taxes_wording")} from wide_facts""", WIDE)
def _(t):
    return R.trace_rows(t.view("facts"), _TAX_RULE).drop("evidence_ids")


@query("r18_evidence_ids", """select doc_id, 'tax' as rule_id, case when k_mrp_text then 'region_' || doc_id % 5 else '' end as evidence from wide_facts""", WIDE)
def _(t):
    out = R.evaluate_rules(t.view("facts"), _TAX_RULE)
    return out.select("doc_id", "rule_id", F.array_join("evidence_ids", ",").alias("evidence"))


_EVERY_FACT = {"rules": [{"id": "evidence", "check": {"all": [leaf(f"{ns}.{key}", "exists") for ns, key, *_ in FACTS]}}]}


@query("r18_trace_evidence", " union all ".join(f"""select doc_id, 'evidence' as rule_id, 'evidence.check.all[{i}]' as path, 'region_' || doc_id % 5 as region_id,
  case when doc_id % 3 = 0 then case when doc_id % 14 = 1 then 0.6::double end when doc_id % 14 <> 1 then 0.95::double end as extraction_confidence from wide_facts where k_{key}"""
                                                for i, (_ns, key, _present, _known, kind, _value) in enumerate(FACTS) if kind != "v_bool"), WIDE)
def _(t):
    k = F.col("doc_id")
    facts = t.view("facts").where("known and size(evidence_ids) > 0")
    rows = facts.select("doc_id", F.col("evidence_ids")[0].alias("region_id"), R.shown(F.struct(*facts.columns)).alias("value"), F.lit(0.95).alias("extraction_confidence"))
    conflicting = rows.where(k % 14 == 1).withColumn("extraction_confidence", F.lit(0.6))
    extraction = rows.withColumn("value", F.when(k % 3 == 0, "other").otherwise(F.col("value"))).unionByName(conflicting)
    return R.trace_evidence(R.trace_rows(t.view("facts"), _EVERY_FACT), extraction)


_NUM = r"([0-9]+(?:[.,][0-9]+)?)\s*(kilograms?|kgs?|grams?|gms?|g|mls?|l|cm|m)\b"


@query("r19_derive_facts", f"""with b as (select *, confidence >= 0.8 as kn from base_fields),
 qy as (select *, regexp_extract(value, {q(_NUM)}, 1)::double as a, lower(regexp_extract(value, {q(_NUM)}, 2)) as u from b where field = 'net_quantity' and regexp_matches(value, {q(_NUM)})),
 f as (select doc_id, 'label' as namespace, 'country_of_origin' as key, kn, null::double as v_num, value as v_str, null::boolean as v_bool from b where field = 'country_of_origin'
  union all select doc_id, 'label', 'generic_name', kn, null, value, null from b where field = 'common_generic_name_of_commodity'
  union all select doc_id, 'package', 'commodity', kn, null, value, null from b where field = 'common_generic_name_of_commodity' and kn
  union all select doc_id, 'label', 'consumer_care_address', kn, null, value, null from b where field = 'consumer_care_details'
  union all select doc_id, 'label', 'consumer_care_phone', kn, null, regexp_extract(value, {q(P.PHONE)}), null from b where field = 'consumer_care_details' and regexp_matches(value, {q(P.PHONE)})
  union all select doc_id, 'label', 'consumer_care_email', kn, null, regexp_extract(value, {q(P.EMAIL)}), null from b where field = 'consumer_care_details' and regexp_matches(value, {q(P.EMAIL)})
  union all select doc_id, 'label', 'mfg_month_year', kn, null, value, null from b where field = 'month_and_year_of_manufacture_or_packing'
  union all select doc_id, 'label', 'net_quantity_text', kn, null, value, null from qy union all select doc_id, 'package', 'net_quantity_value', kn, a, null, null from qy
  union all select doc_id, 'package', 'net_quantity_unit', kn, null, u, null from qy union all select doc_id, 'package', 'net_quantity_basis', kn, null, case when u in ('g','kg') then 'mass' else 'volume' end, null from qy
  union all select doc_id, 'package', 'net_quantity_in_kg_or_l', kn, a * case when u in ('kg', 'l') then 1.0 else 0.001 end, null, null from qy
  union all select doc_id, 'package', 'net_quantity_in_g_or_ml', kn, a * case when u in ('kg', 'l') then 1.0 else 0.001 end * 1000, null, null from qy
  union all select doc_id, 'label', 'mrp_text', kn, null, value, null from b where field = 'maximum_retail_price_mrp'
  union all select doc_id, 'label', 'mrp_value', kn, regexp_extract(value, '([0-9]+(?:[.,][0-9]{{1,2}})?)', 1)::double, null, null from b where field = 'maximum_retail_price_mrp' and regexp_matches(value, '[0-9]')
  union all select doc_id, 'label', 'mrp_currency_indian', kn, null, null, regexp_matches(value, '(?i)\\bRs\\.?|\\bINR\\b') from b where field = 'maximum_retail_price_mrp'
  union all select doc_id, 'label', 'mrp_inclusive_of_taxes_wording', kn, null, null, regexp_matches(value, {q(P.TAX_WORDING)}) from b where field = 'maximum_retail_price_mrp'
  union all select doc_id, 'label', 'unit_sale_price_value', kn, regexp_extract(value, 'Rs ([0-9.]+)/kg', 1)::double, null, null from b where field = 'unit_sale_price'
  union all select doc_id, 'label', 'unit_sale_price_unit', kn, null, 'per kg', null from b where field = 'unit_sale_price')
 select doc_id, namespace, key, kn as known, case when kn then round(v_num, 6) end as v_num, case when kn then v_str end as v_str, case when kn then v_bool end as v_bool from f""", ("base_fields",))
def _(t):
    care = F.when(F.col("field") == "consumer_care_details", F.col("value"))
    fields = t.view("base_fields").select(
        "*", F.lit(True).alias("detected"), F.expr("cast(array() as array<string>)").alias("region_ids"), F.lit(None).cast("string").alias("care_name"),
        care.alias("care_address"), group(care, P.PHONE, 0).alias("care_telephone_number"), group(care, P.EMAIL, 0).alias("care_email_address"))
    out = R.derive_facts(fields)
    return out.select("doc_id", "namespace", "key", "known", F.round("v_num", 6).alias("v_num"), "v_str", "v_bool")


_LATER = {"v_str": "case when k % 2 = 0 and {0} is not null then 'overridden' else {0} end", "v_num": "case when k % 2 = 0 then {0} + 1 else {0} end"}


def _merged_sql(ns: str, key: str, present: str, known: str, kind: str, value: str) -> str:
    value = _LATER.get(kind, "{0}").format(f"case when {known} then {value.replace('ARR(nm, category)', '[nm, category]')} end")
    cells = {"v_num": "null::double", "v_str": "null::varchar", "v_bool": "null::boolean", "v_arr": "null::varchar[]"} | {kind: value}
    return f"select k as doc_id, '{ns}' as namespace, '{key}' as key, {known} as known, " + ", ".join(f"{c} as {n}" for n, c in cells.items()) + f" from label_base where {present}"


@query("r19_merge_facts", "select * replace (round(v_num, 6) as v_num, array_to_string(v_arr, '|') as v_arr) from (" + " union all ".join(_merged_sql(*f) for f in FACTS)
       + " union all select k, 'package', 'note', true, null, 'later only', null, null from label_base where k % 4 = 0)", ("label_base",))
def _(t):
    base = t.view("facts")
    later = base.where("doc_id % 2 = 0").withColumns({"v_str": F.when(F.col("v_str").isNotNull(), "overridden"), "v_num": F.col("v_num") + 1})
    only = t.part.where("p_partkey % 4 = 0").select(
        F.col("p_partkey").alias("doc_id"), F.lit("package").alias("namespace"), F.lit("note").alias("key"), F.lit(True).alias("known"),
        F.lit(None).cast("double").alias("v_num"), F.lit("later only").alias("v_str"), F.lit(None).cast("boolean").alias("v_bool"),
        F.expr("cast(null as array<string>)").alias("v_arr"), F.expr("cast(array() as array<string>)").alias("evidence_ids"))
    return R.merge_facts([base, later, only]).select("doc_id", "namespace", "key", "known", F.round("v_num", 6).alias("v_num"), "v_str", "v_bool",
                                                      F.array_join("v_arr", "|").alias("v_arr"))


@query("r20_canonical_quantity", f"select doc_id, round({_CANONICAL_SQL}, 9) as canonical from wide_facts", WIDE)
def _(t):
    return quantity_facts(t).select("doc_id", F.round("canonical", 9).alias("canonical"))


@query("j8_font_height", f"""select doc_id, area, case when doc_id % 3 = 0 then normal_mm when doc_id % 3 = 1 then molded_mm when normal_mm = molded_mm then normal_mm end as height_mm
 from (select p_partkey as doc_id, (p_size * 70)::double as area from part) left join {sql_values("font_height", ["low", "high", "normal_mm", "molded_mm"])} on (low is null or area > low) and (high is null or area <= high)""")
def _(t):
    panels = t.part.select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") * 70).cast("double").alias("area"))
    banded = K.band_lookup(panels, table(t.spark, "font_height"), "area")
    k = F.col("doc_id")
    return banded.select("doc_id", "area", F.when(k % 3 == 0, F.col("normal_mm")).when(k % 3 == 1, F.col("molded_mm"))
                         .when(F.col("normal_mm") == F.col("molded_mm"), F.col("normal_mm")).alias("height_mm"))


@query("j8_sampling_plan", f"""select l_partkey as lot_id, n as lot_size, sample_size, allowed from (select l_partkey, count(*) n from lineitem group by 1)
 left join {sql_values("sampling_plan", ["low", "high", "sample_size", "correction", "allowed"])} on n between low and high""")
def _(t):
    lots = t.lineitem.groupBy(F.col("l_partkey").alias("lot_id")).agg(F.count("*").alias("lot_size"))
    return K.band_lookup(lots, table(t.spark, "sampling_plan"), "lot_size", low_open=False).select("lot_id", "lot_size", "sample_size", "allowed")


@query("j8_unit_price_units", f"""select doc_id, case when b is null or c is null then null when b = 'mass' then case when c < 1 then 'per g' else 'per kg' end else case when c < 1 then 'per ml' else 'per l' end end as unit_price_unit
 from (select doc_id, v_net_quantity_basis as b, {_CANONICAL_SQL} as c from wide_facts)""", WIDE)
def _(t):
    return K.unit_price_units(quantity_facts(t), table(t.spark, "unit_price_units"))


@query("j8_magnitude_units", f"with {_UNITS_SQL} select doc_id, array_to_string(allowed, ',') as allowed_units from um", WIDE)
def _(t):
    out = K.magnitude_units(quantity_facts(t), table(t.spark, "units_by_magnitude"))
    return out.select("doc_id", F.array_join("allowed_units", ",").alias("allowed_units"))


@query("j9_longest_match", f"""with m as (select p_partkey as doc_id, entry, bases, length(entry) n, max(length(entry)) over (partition by p_partkey) mx from part
   join {sql_values("quantity_basis", ["entry", "declared_in"]).replace("declared_in)", "bases)")} on contains(lower(p_name), entry)),
 o as (select doc_id, min(entry) entry, any_value(bases) bases, count(*) c from m where n = mx group by 1)
 select p.p_partkey as doc_id, case when c = 1 then entry end as entry, case when c = 1 then array_to_string(bases, ',') end as bases from part p left join o on o.doc_id = p.p_partkey""")
def _(t):
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("commodity"))
    return K.longest_match(docs, table(t.spark, "quantity_basis")).withColumn("bases", F.array_join("bases", ","))


@query("c1_panel_area", """select p_partkey as doc_id, round(case p_partkey % 5 when 0 then p_size::double when 1 then case when p_partkey % 7 <> 0 then 10.0 * p_size end when 2 then 12.0 * p_size * 0.4 when 3 then p_size * 20 * 0.4 end, 6) as panel_area_cm2,
 case when p_partkey % 5 = 4 or (p_partkey % 5 = 1 and p_partkey % 7 = 0) then 'NOT_ASSESSED' else 'CALCULATED' end as status from part""")
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    none = F.lit(None).cast("double")
    packages = t.part.select(
        k.alias("doc_id"), F.when(k % 5 == 0, size).alias("area_cm2"),
        F.when(k % 5 == 1, "rectangular").when(k % 5 == 2, "cylindrical").when(k % 5 == 3, "other").when(k % 5 == 4, "star").alias("shape"),
        F.when(k % 5 == 1, 10.0).alias("height_cm"), F.when(k % 5 == 2, 120.0).alias("height_mm"), F.when(k % 7 != 0, size).alias("width_cm"), none.alias("width_mm"),
        size.alias("circumference_cm"), none.alias("circumference_mm"), none.alias("considered_cm2"), (size * 20).alias("surface_cm2"))
    out = C.panel_area(packages, {"rectangular": 1.0, "cylindrical": 0.4, "other": 0.4})
    return out.withColumn("panel_area_cm2", F.round("panel_area_cm2", 6))


_MPE_SQL = f"""mpe as (select *, case when absolute is not null then absolute::double when declared <= 1000 then round(declared::decimal(18,6) * percent::decimal(9,4) / 100, 1)::double else ceil(declared::decimal(18,6) * percent::decimal(9,4) / 100)::double end as mpe
  from (select p_partkey as doc_id, (p_size * p_size * 9 + p_partkey % 60)::double as declared from part) left join {sql_values("permissible_error", ["low", "high", "absolute", "percent"])} on (low is null or declared > low) and (high is null or declared <= high))"""


def _declared(t):
    return t.part.select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") * F.col("p_size") * 9 + F.col("p_partkey") % 60).cast("double").alias("declared"))


@query("c2_max_permissible_error", f"with {_MPE_SQL} select doc_id, declared, mpe from mpe")
def _(t):
    return C.max_permissible_error(_declared(t), table(t.spark, "permissible_error"))


@query("c3_package_deficiency", f"""with {_MPE_SQL}, a as (select *, case when doc_id % 6 <> 0 then declared - doc_id % 23 end as actual from mpe)
 select doc_id, case when actual is null then 'NOT_ASSESSED' else 'CALCULATED' end as status, case when actual is not null then greatest(0, declared - actual) end as error,
  greatest(0, declared - actual) > mpe and actual is not null as exceeds_mpe, actual is not null and greatest(0, declared - actual) > 2 * mpe as exceeds_twice_mpe from a""")
def _(t):
    p = C.max_permissible_error(_declared(t), table(t.spark, "permissible_error"))
    p = p.withColumn("actual", F.when(F.col("doc_id") % 6 != 0, F.col("declared") - F.col("doc_id") % 23))
    out = C.package_deficiency(p).select("doc_id", "status", "error", "exceeds_mpe", "exceeds_twice_mpe")
    return out.withColumn("exceeds_mpe", F.coalesce("exceeds_mpe", F.lit(False))).withColumn("exceeds_twice_mpe", F.coalesce("exceeds_twice_mpe", F.lit(False)))


_LOT_SQL = f"""lots as (select l_partkey as lot_id, count(*) as lot_size, round(avg(l_quantity)) as declared from lineitem group by 1),
 pl as (select lots.*, sample_size, correction, allowed from lots left join {sql_values("sampling_plan", ["low", "high", "sample_size", "correction", "allowed"])} on lot_size between low and high),
 pm as (select pl.*, case when absolute is not null then absolute::double else round(declared::decimal(18,6) * percent::decimal(9,4) / 100, 1)::double end as mpe from pl
  left join {sql_values("permissible_error", ["low", "high", "absolute", "percent"])} on (low is null or declared > low) and (high is null or declared <= high)),
 sm as (select l_partkey as lot_id, l_quantity as quantity, l_returnflag <> 'R' or l_partkey % 4 <> 0 as ok, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) rn from lineitem)"""


def _lots(t):
    lots = t.lineitem.groupBy(F.col("l_partkey").alias("lot_id")).agg(F.count("*").alias("lot_size"), F.round(F.avg("l_quantity")).alias("declared"))
    from pyspark.sql import Window as W
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    first = t.lineitem.withColumn("rn", F.row_number().over(W.partitionBy("l_partkey").orderBy(*order)))
    sizes = K.band_lookup(lots, table(t.spark, "sampling_plan"), "lot_size", low_open=False).select(F.col("lot_id").alias("_lot"), "sample_size")
    take = F.col("sample_size") - F.when(F.col("l_partkey") % 9 == 0, 1).otherwise(0)
    samples = first.join(sizes, F.col("l_partkey") == F.col("_lot")).where(F.col("rn") <= take).select(
        F.col("l_partkey").alias("lot_id"), F.col("l_quantity").alias("quantity"),
        ((F.col("l_returnflag") != "R") | (F.col("l_partkey") % 4 != 0)).alias("declarations_present"))
    return lots, samples


@query("c4_lot_approval", f"""with {_LOT_SQL},
 st as (select pm.lot_id, count(*) n, avg(quantity) m, coalesce(stddev_samp(quantity), 0) sd, count(*) filter (where greatest(0, declared - quantity) > mpe and greatest(0, declared - quantity) < 2 * mpe) bt,
   bool_or(greatest(0, declared - quantity) > 2 * mpe) ov, bool_and(ok) al from pm join sm on sm.lot_id = pm.lot_id and rn <= sample_size - case when pm.lot_id % 9 = 0 then 1 else 0 end group by 1)
 select pm.lot_id, lot_size, sample_size, coalesce(n, 0) as samples, case when coalesce(n, 0) <> sample_size then 'NOT_ASSESSED' when m + sd * correction >= declared and bt <= allowed and not ov and al then 'PASS' else 'FAIL' end as status,
  case when n = sample_size then round(m + sd * correction, 6) end as corrected_average from pm left join st using (lot_id)""")
def _(t):
    lots, samples = _lots(t)
    out = C.lot_approval(lots, samples, table(t.spark, "sampling_plan"), table(t.spark, "permissible_error"))
    return out.select("lot_id", "lot_size", "sample_size", "samples", "status", F.round("corrected_average", 6).alias("corrected_average"))


@query("c5_tare_procedure", """with l as (select p_partkey as lot_id, case when p_partkey % 3 = 1 then 'volume' else 'mass' end as basis, case when p_partkey % 11 <> 0 then (p_size * 0.5)::double end as mpe, case when p_partkey % 2 = 0 then (p_partkey % 17)::double end as st, case when p_partkey % 4 <> 0 then p_partkey % 4 <> 1 end as gc from part),
 ta as (select l_partkey as lot_id, count(*) n, max(tare) - min(tare) sp, avg(tare) mt from (select l_partkey, l_linenumber, l_quantity / 10 as tare, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 as pos from lineitem) where pos < 5 group by 1)
 , j as (select l.*, n, sp, mt, case when mpe is null then 'not_assessed' when basis = 'volume' and gc is null then 'not_assessed' when basis = 'volume' and not gc then 'measure_by_volume' when st <= mpe * 0.3 then 'single_tare' when coalesce(n, 0) < 5 then 'not_assessed' when sp <= mpe * 0.2 then 'mean_tare' else 'individual_tare' end as procedure from l left join ta using (lot_id))
 select lot_id, procedure, case procedure when 'single_tare' then 'CALCULATED' when 'mean_tare' then 'CALCULATED' when 'individual_tare' then 'REVIEW_REQUIRED' else 'NOT_ASSESSED' end as status, round(case procedure when 'single_tare' then st when 'mean_tare' then mt end, 6) as tare from j""")
def _(t):
    from pyspark.sql import Window as W
    k = F.col("p_partkey")
    lots = t.part.select(k.alias("lot_id"), F.when(k % 3 == 1, "volume").otherwise("mass").alias("basis"), F.when(k % 11 != 0, F.col("p_size") * 0.5).alias("mpe"),
                         F.when(k % 2 == 0, (k % 17).cast("double")).alias("single_tare"), F.when(k % 4 != 0, k % 4 != 1).alias("gravity_constant"))
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    tares = t.lineitem.withColumn("rn", F.row_number().over(W.partitionBy("l_partkey").orderBy(*order))).where("rn <= 5").select(
        F.col("l_partkey").alias("lot_id"), (F.col("rn") - 1).alias("pos"), (F.col("l_quantity") / 10).alias("tare"))
    return C.tare_procedure(lots, tares).withColumn("tare", F.round("tare", 6))


@query("c6_net_weight", """select status, count(*) as n from (select case when p_partkey % 5 = 0 then 'NEEDS_MANUAL_VERIFICATION' when p_partkey % 4 = 0 then 'NON_COMPLIANT' else 'COMPLIANT' end as status from part) group by 1""")
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    rows = t.part.select(F.when(k % 5 != 0, size + 12.5).alias("total"), F.lit(12.5).alias("wrapper"), (size + F.when(k % 4 == 0, 0.01).otherwise(0.0)).alias("net"))
    return C.outcome_profile(C.net_weight_rule(rows))


@query("c7_verification_interval", """select o_orderkey as doc_id, case when o_orderkey % 3 = 0 then (d + interval 24 month)::date else (d + interval 12 month)::date end as expires,
 case when (case when o_orderkey % 3 = 0 then (d + interval 24 month)::date else (d + interval 12 month)::date end) >= date '1998-06-30' then 'COMPLIANT' else 'NON_COMPLIANT' end as status from (select o_orderkey, o_orderdate::date as d from orders)""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("last_verified"),
                           F.when(F.col("o_orderkey") % 3 == 0, "Weight measure").otherwise("clock").alias("instrument_category"))
    return C.verification_interval(rows, F.lit("1998-06-30").cast("date")).select("doc_id", "expires", "status")
