"""Rules as data, compiled to Column expressions.

A fact is a struct ``(known, v_num, v_str, v_bool, v_arr)``. UNKNOWN is SQL NULL of the truth value and nothing
else: an absent or unknown fact yields NULL, a known null yields a definite answer. ``all``, ``any`` and ``not`` are
AND, OR and NOT, whose SQL form is the same three-valued logic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import measures as M
from labelwright.functions import patterns as P
from labelwright.functions.text import group, has, let
from labelwright.operators.lines import emit

FACT_TYPE = "struct<known:boolean,v_num:double,v_str:string,v_bool:boolean,v_arr:array<string>,evidence_ids:array<string>>"
TIMES = re.compile(r"^([0-9]+(?:\.[0-9]+)?) x (\S+)$")


def fact(c: Column, **value: Column) -> Column:
    """A computed value as a fact; it is known where the value is not NULL."""
    (kind, v), = value.items()
    part = lambda name, t: (v if name == kind else F.lit(None)).cast(t).alias(name)
    return F.struct(v.isNotNull().alias("known"), part("v_num", "double"), part("v_str", "string"),
                    part("v_bool", "boolean"), part("v_arr", "array<string>"),
                    F.lit(None).cast("array<string>").alias("evidence_ids"))


def paths_in(node) -> set[str]:
    """Fact paths a rule tree refers to."""
    if isinstance(node, list):
        return set().union(*map(paths_in, node)) if node else set()
    if not isinstance(node, dict):
        return set()
    found = set().union(*map(paths_in, node.values())) if node else set()
    if isinstance(node.get("field"), str):
        found.add(node["field"])
    source = node.get("value_from")
    if isinstance(source, str) and not source.startswith("lookup_tables."):
        times = TIMES.match(source)
        found.add(times.group(2) if times else source)
    if "applies_to" in node:
        found.add("entity.role")
    return found


def column_of(path: str) -> str:
    return "f_" + path.replace(".", "__")


def widen_facts(facts: DataFrame, paths: set[str]) -> DataFrame:
    """Long facts to one row per document, only for the paths the rules use; one aggregate with map-side merge."""
    value = F.struct("known", "v_num", "v_str", "v_bool", "v_arr", "evidence_ids")
    path = F.concat_ws(".", "namespace", "key")
    return facts.groupBy("doc_id").agg(*[
        F.first(F.when(path == p, value), ignorenulls=True).alias(column_of(p)) for p in sorted(paths)])


# ---- leaf operators -----------------------------------------------------------------------------

def _known(f: Column) -> Column:
    return F.coalesce(f["known"], F.lit(False))


def _is_null(f: Column) -> Column:
    return f["v_num"].isNull() & f["v_str"].isNull() & f["v_bool"].isNull() & f["v_arr"].isNull()


def _equals_literal(f: Column, value) -> Column:
    if value is None:
        return _is_null(f)
    if isinstance(value, bool):
        return F.coalesce(f["v_bool"] == value, F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(f["v_num"] == float(value), F.lit(False))
    return F.coalesce(f["v_str"] == value, F.lit(False))


def _equals_fact(f: Column, other: Column) -> Column:
    same = lambda part: F.coalesce(f[part] == other[part], F.lit(False))
    member = F.coalesce(F.array_contains(other["v_arr"], f["v_str"]), F.lit(False))
    return F.when(other["v_arr"].isNotNull(), member).otherwise(
        same("v_num") | same("v_str") | same("v_bool") | (_is_null(f) & _is_null(other)))


def _one_of(f: Column, options: list) -> Column:
    return reduce(lambda a, b: a | b, [_equals_literal(f, o) for o in options], F.lit(False))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _contains(f: Column, value) -> Column:
    if not isinstance(value, str):
        return F.when(f["v_arr"].isNotNull(), F.array_contains(f["v_arr"], str(value))).otherwise(F.lit(False))
    in_text = F.lower(f["v_str"]).contains(value.lower())
    return F.when(f["v_str"].isNotNull(), in_text).when(
        f["v_arr"].isNotNull(), F.array_contains(f["v_arr"], value)).otherwise(F.lit(False))


def apply_operator(f: Column, op: str, value=None, other: Column | None = None) -> Column:
    """Truth of one comparison; NULL is UNKNOWN. ``other`` is the comparison fact of a ``value_from``."""
    known = _known(f)
    if op in ("exists", "not_exists"):
        result = ~_is_null(f) if op == "exists" else _is_null(f)
        return F.when(known, result)
    if other is not None:
        known = known & _known(other)
    if op in ("eq", "ne"):
        same = _equals_fact(f, other) if other is not None else (
            _one_of(f, value) if isinstance(value, list) else _equals_literal(f, value))
        return F.when(known, same if op == "eq" else ~same)
    if op in ("gt", "gte", "lt", "lte"):
        left = _finite(f["v_num"])
        numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
        right = _finite(other["v_num"]) if other is not None else (F.lit(float(value)) if numeric else F.lit(None).cast("double"))
        compared = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]
        return F.when(known, compared)
    if op in ("in", "not_in"):
        if other is not None:
            member = F.when(other["v_arr"].isNotNull(), _equals_fact(f, other))
        elif isinstance(value, list):
            member = _one_of(f, value)
        else:
            return F.lit(None).cast("boolean")
        return F.when(known, member if op == "in" else ~member)
    if op == "matches":
        return F.when(known & f["v_str"].isNotNull(), f["v_str"].rlike(value)) if isinstance(value, str) else F.lit(None).cast("boolean")
    if op == "contains":
        return F.when(known, _contains(f, value))
    if op in ("contains_any", "not_contains_any"):
        if other is not None:
            listed = F.coalesce(other["v_arr"], F.expr("cast(array() as array<string>)"))
            hit = F.when(f["v_str"].isNotNull(), F.exists(listed, lambda o: F.lower(f["v_str"]).contains(F.lower(o)))).when(
                f["v_arr"].isNotNull(), F.arrays_overlap(f["v_arr"], listed)).otherwise(F.lit(False))
        else:
            options = value if isinstance(value, list) else []
            hit = reduce(lambda a, b: a | b, [_contains(f, o) for o in options], F.lit(False))
        return F.when(known, hit if op == "contains_any" else ~hit)
    if op == "between":
        if not (isinstance(value, list) and len(value) == 2):
            return F.lit(None).cast("boolean")
        return F.when(known, _finite(f["v_num"]).between(float(value[0]), float(value[1])))
    raise ValueError(f"unknown operator {op}")


# ---- trees --------------------------------------------------------------------------------------

@dataclass
class Compiled:
    truth: Column
    trace: list[Column] = field(default_factory=list)


def truth_name(c: Column) -> Column:
    return F.when(c.isNull(), "UNKNOWN").when(c, "TRUE").otherwise("FALSE")


def shown(f: Column) -> Column:
    """A fact's value as text, for the trace."""
    plain = F.when(f["v_num"] == F.floor(f["v_num"]), f["v_num"].cast("bigint").cast("string")).otherwise(f["v_num"].cast("string"))
    return F.when(~_known(f), "UNKNOWN").otherwise(F.coalesce(
        plain, f["v_str"], f["v_bool"].cast("string"), F.array_join(f["v_arr"], "|"), F.lit("null")))


def _trace_row(path: str, fact_path: str | None, op: str, actual: Column, expected: str, result: Column, ids: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(fact_path).cast("string").alias("field"), F.lit(op).alias("operator"),
                    actual.alias("actual"), F.lit(expected).alias("expected"), truth_name(result).alias("result"), ids.alias("evidence_ids"))


def no_ids() -> Column:
    return F.expr("cast(array() as array<string>)")


def compile_condition(node: dict, lookups: dict[str, Column] | None = None, location: str = "check") -> Compiled:
    """A condition tree as one Column (and its trace rows). Compiled once, evaluated for every document."""
    for name, merge in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
        if name in node:
            parts = [compile_condition(child, lookups, f"{location}.{name}[{i}]") for i, child in enumerate(node[name])]
            truth = reduce(merge, [p.truth for p in parts])
            rows = [r for p in parts for r in p.trace]
            return Compiled(truth, rows + [_trace_row(location, None, name, F.lit(None).cast("string"), "", truth, no_ids())])
    if "not" in node:
        inner = compile_condition(node["not"], lookups, f"{location}.not")
        return Compiled(~inner.truth, inner.trace + [_trace_row(location, None, "not", F.lit(None).cast("string"), "", ~inner.truth, no_ids())])

    f, op, other, value = F.col(column_of(node["field"])), node["op"], None, node.get("value")
    source = node.get("value_from")
    if source:
        times = TIMES.match(source)
        if times:
            base = F.col(column_of(times.group(2)))
            other = fact(base, v_num=F.when(_known(base), _finite(base["v_num"])) * float(times.group(1)))
        elif source.startswith("lookup_tables."):
            other = (lookups or {}).get(source.partition(".")[2], F.lit(None).cast(FACT_TYPE))
        else:
            other = F.col(column_of(source))
    truth = apply_operator(f, op, value, other)
    ids = F.coalesce(f["evidence_ids"], no_ids())
    return Compiled(truth, [_trace_row(location, node["field"], op, shown(f), source or str(value), truth, ids)])


def compile_exemptions(exemptions: list[dict], lookups=None, location: str = "exemptions") -> Compiled:
    """Any exemption: condition AND requires AND NOT except_when AND every conditional requirement."""
    truths, rows = [], []
    for i, e in enumerate(exemptions):
        parts = [compile_condition(e["condition"], lookups, f"{location}[{i}].condition")]
        if "requires" in e:
            parts.append(compile_condition(e["requires"], lookups, f"{location}[{i}].requires"))
        truth = reduce(lambda a, b: a & b, [p.truth for p in parts])
        if "except_when" in e:
            out = compile_condition(e["except_when"], lookups, f"{location}[{i}].except_when")
            parts.append(out)
            truth = truth & ~out.truth
        for j, need in enumerate(e.get("conditional_requirements", [])):
            got = compile_condition(need, lookups, f"{location}[{i}].conditional_requirements[{j}]")
            parts.append(got)
            truth = truth & got.truth
        truths.append(truth)
        rows += [r for p in parts for r in p.trace]
    return Compiled(reduce(lambda a, b: a | b, truths, F.lit(False)), rows)


def retail_scope(exempt: Column) -> Column:
    """Whether the retail chapter applies: unknown package type is UNKNOWN; wholesale, export or exempt is FALSE."""
    kind = F.col(column_of("package.package_type"))
    return (F.when(~_known(kind), F.lit(None).cast("boolean"))
            .when(F.coalesce(kind["v_str"].isin("wholesale", "export"), F.lit(False)), F.lit(False))
            .otherwise(~exempt))


def actor_scope(roles: list[str]) -> Column:
    role = F.col(column_of("entity.role"))
    return F.when(_known(role), F.coalesce(role["v_str"].isin(*roles), F.lit(False)))


def rule_status(scope: Column, check: Column | None) -> Column:
    status = F.when(F.coalesce(~scope, F.lit(False)), "NOT_APPLICABLE")
    if check is None:
        return status.otherwise("NOT_ASSESSED")
    return status.when(scope.isNull() | check.isNull(), "REVIEW_REQUIRED").when(check, "PASS").otherwise("FAIL")


def ruleset_paths(ruleset: dict) -> set[str]:
    return paths_in(ruleset) | {"package.package_type", "entity.role"}


def evaluate_rules(facts: DataFrame, ruleset: dict, lookups: dict[str, Column] | None = None,
                   with_trace: bool = False) -> DataFrame:
    """Every rule against every document: one aggregate to widen the facts, then one projection."""
    wide = widen_facts(facts, ruleset_paths(ruleset))
    return evaluate_wide(wide, ruleset, lookups, with_trace)


def evaluate_wide(wide: DataFrame, ruleset: dict, lookups: dict[str, Column] | None = None, with_trace: bool = False) -> DataFrame:
    gates = ruleset.get("applicability", {})
    retail = compile_exemptions(gates.get("retail_exemptions", []), lookups, "applicability.retail")
    general = compile_exemptions(gates.get("general_exemptions", []), lookups, "applicability.general")
    staged = wide.withColumn("_retail", retail_scope(retail.truth)).withColumn("_exempt", general.truth)
    rows = []
    for rule in ruleset["rules"]:
        scope, trace = ~F.col("_exempt"), []
        if rule.get("chapter") == "retail":
            scope = F.col("_retail") & scope
        if "applies_when" in rule:
            when = compile_condition(rule["applies_when"], lookups, f"{rule['id']}.applies_when")
            scope, trace = scope & when.truth, trace + when.trace
        if "applies_to" in rule:
            scope = scope & actor_scope(rule["applies_to"])
        check = compile_condition(rule["check"], lookups, f"{rule['id']}.check") if "check" in rule else None
        trace += check.trace if check else []
        columns = [F.lit(rule["id"]).alias("rule_id"), F.lit(rule.get("severity")).alias("severity"),
                   truth_name(scope).alias("applicability"), rule_status(scope, check.truth if check else None).alias("status"),
                   F.lit(check is not None).alias("has_check")]
        cited = [r for r in trace]
        ids = F.array_distinct(F.flatten(F.transform(F.array(*cited), lambda r: r["evidence_ids"]))) if cited else no_ids()
        columns.append(ids.alias("evidence_ids"))
        if with_trace:
            columns.append((F.array(*cited) if cited else F.array()).alias("trace"))
        rows.append(F.struct(*columns))
    return emit(staged, F.array(*rows))


def trace_rows(facts: DataFrame, ruleset: dict, lookups: dict[str, Column] | None = None) -> DataFrame:
    """One row per evaluated leaf or combinator of every rule."""
    traced = {**ruleset, "rules": [r for r in ruleset["rules"] if "check" in r or "applies_when" in r]}
    results = evaluate_rules(facts, traced, lookups, with_trace=True)
    return emit(results, F.col("trace"), "doc_id", "rule_id")


def trace_evidence(trace: DataFrame, extraction: DataFrame) -> DataFrame:
    """Extraction confidence for cited evidence, only where the traced value is the extracted value.

    ``extraction(doc_id, region_id, value, extraction_confidence)``; conflicting confidences give NULL.
    """
    agreed = extraction.groupBy("doc_id", "region_id", "value").agg(
        F.min("extraction_confidence").alias("_lo"), F.max("extraction_confidence").alias("_hi"))
    cited = trace.where("actual is not null and actual <> 'UNKNOWN'").select(
        "doc_id", "rule_id", "path", "actual", F.explode("evidence_ids").alias("region_id"))
    match = (cited["doc_id"] == agreed["doc_id"]) & (cited["region_id"] == agreed["region_id"]) & (cited["actual"] == agreed["value"])
    return cited.join(agreed, match, "left").select(
        cited["doc_id"], "rule_id", "path", cited["region_id"],
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("extraction_confidence"))


# ---- facts from fields --------------------------------------------------------------------------

def derive_facts(fields: DataFrame, threshold: float = P.FIELD_CONFIDENCE) -> DataFrame:
    """Facts from the field table; a field below the threshold contributes its evidence only.

    One row per field becomes its facts in place: a projection.
    """
    value = F.col("value")
    name = F.col("field")
    null_str, null_num, null_bool = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("boolean")

    def row(when: Column, namespace: str, key: str, *, num=null_num, text=null_str, flag=null_bool) -> Column:
        filled = num.isNotNull() | text.isNotNull() | flag.isNotNull()
        return F.when(when & filled, F.struct(
            F.lit(namespace).alias("namespace"), F.lit(key).alias("key"), (F.col("confidence") >= threshold).alias("known"),
            F.when(F.col("confidence") >= threshold, num).alias("v_num"), F.when(F.col("confidence") >= threshold, text).alias("v_str"),
            F.when(F.col("confidence") >= threshold, flag).alias("v_bool"), F.lit(None).cast("array<string>").alias("v_arr"),
            F.col("region_ids").alias("evidence_ids")))

    amount = F.regexp_replace(group(value, r"([0-9]+(?:[.,][0-9]+)?)\s*(?:kilograms?|kgs?|grams?|gms?|g|millilit(?:er|re)s?|mls?|lit(?:er|re)s?|l|cm3|dm3|m3|cm|m|dm2|m2|number|unit|piece|pair|set)\b"), ",", ".").try_cast("double")
    unit = M.normal_unit(group(value, r"[0-9]+(?:[.,][0-9]+)?\s*(kilograms?|kgs?|grams?|gms?|g|millilit(?:er|re)s?|mls?|lit(?:er|re)s?|l|cm3|dm3|m3|cm|m|dm2|m2|number|unit|piece|pair|set)\b"))
    basis = (F.when(unit.isin("g", "kg"), "mass").when(unit.isin("ml", "l"), "volume").when(unit.isin("cm", "m"), "length")
             .when(unit.isin("dm2", "m2"), "area").when(unit.isin("number", "unit", "piece", "pair", "set"), "number"))
    canonical = amount * M.canonical_factor(basis, unit)
    is_q, is_p, is_u = name == "net_quantity", name == "maximum_retail_price_mrp", name == "unit_sale_price"
    bulk = F.when(basis.isin("mass", "volume"), canonical)
    price = F.regexp_replace(group(value, r"(?:₹|Rs\.?|INR)?\s*([0-9]+(?:[.,][0-9]{1,2})?)"), ",", ".").try_cast("double")
    per = r"(?:₹|Rs\.?|INR)?\s*([0-9]+(?:[.,][0-9]{1,2})?)\s*(?:/|per\s+)(kg|g|ml|l|m|cm|unit|number)\b"
    rows = F.array_compact(F.array(
        row(name == "country_of_origin", "label", "country_of_origin", text=value),
        row(name == "common_generic_name_of_commodity", "label", "generic_name", text=value),
        row((name == "common_generic_name_of_commodity") & (F.col("confidence") >= threshold), "package", "commodity", text=value),
        row(name == "month_and_year_of_manufacture_or_packing", "label", "mfg_month_year", text=value),
        row(is_q & basis.isNotNull(), "label", "net_quantity_text", text=value),
        row(is_q & basis.isNotNull(), "package", "net_quantity_value", num=amount),
        row(is_q & basis.isNotNull(), "package", "net_quantity_unit", text=unit),
        row(is_q, "package", "net_quantity_basis", text=basis),
        row(is_q, "package", "net_quantity_in_g_or_ml", num=bulk * 1000),
        row(is_q, "package", "net_quantity_in_kg_or_l", num=bulk),
        row(is_p, "label", "mrp_text", text=value), row(is_p, "label", "mrp_value", num=price),
        row(is_p, "label", "mrp_currency_indian", flag=has(value, r"₹|\bRs\.?|\bINR\b")),
        row(is_p, "label", "mrp_inclusive_of_taxes_wording", flag=has(value, P.TAX_WORDING)),
        row(is_u, "label", "unit_sale_price_value", num=F.regexp_replace(group(value, per), ",", ".").try_cast("double")),
        row(is_u, "label", "unit_sale_price_unit", text=F.concat(F.lit("per "), M.normal_unit(group(value, per, 2)))),
        row(name == "consumer_care_details", "label", "consumer_care_phone", text=F.col("care_telephone_number")),
        row(name == "consumer_care_details", "label", "consumer_care_email", text=F.col("care_email_address")),
        row(name == "consumer_care_details", "label", "consumer_care_address", text=F.col("care_address")),
        row(name == "consumer_care_details", "label", "consumer_care_name", text=F.col("care_name"))))
    return emit(fields.where("detected"), rows)


def merge_facts(sources: list[DataFrame]) -> DataFrame:
    """Later sources override earlier ones per (document, namespace, key)."""
    ranked = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    stacked = reduce(DataFrame.unionByName, ranked)
    value = F.struct("known", "v_num", "v_str", "v_bool", "v_arr", "evidence_ids")
    return (stacked.groupBy("doc_id", "namespace", "key").agg(F.max_by(value, "_prio").alias("v"))
            .select("doc_id", "namespace", "key", "v.*"))


def normalised_quantities(df: DataFrame, value: str = "value", unit: str = "unit", basis: str = "basis") -> DataFrame:
    """Quantities in the canonical unit of their basis; NULL for a unit the basis does not know."""
    factor = M.canonical_factor(F.col(basis), M.normal_unit(F.col(unit)))
    return df.withColumn("canonical", F.col(value) * factor)
