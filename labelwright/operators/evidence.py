"""Linking values to the boxes that support them, the field table of a document, and overlays on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import measures as M
from labelwright.functions import patterns as P
from labelwright.functions.text import (
    first_where, group, has, index_of, let, lookup, padded_tokens, strip,
)
from labelwright.operators import lines as L

NAME_FACTOR = 0.75


# ---- evidence -----------------------------------------------------------------------------------

def tokened(detections: Column) -> Column:
    """Detections that can support a value, with their token sequence, computed once per box: those without tokens are left
    out. ``usable`` is false for a box of one token that is no label that stands alone."""
    alone = [f" {w} " for w in P.EVIDENCE_SINGLE_LABELS]
    boxes = F.transform(detections, lambda d: let(padded_tokens(d["text"]), lambda tok: F.struct(
        d["pos"].alias("pos"), d["text"].alias("text"), d["confidence"].alias("confidence"), tok.alias("tok"),
        ((F.locate(" ", tok, 2) != F.length(tok)) | tok.isin(*alone)).alias("usable"))))
    return F.filter(boxes, lambda d: F.length(d["tok"]) > 2)


def supporting(boxes: Column, text: Column) -> Column:
    """Boxes whose token sequence equals, contains or is contained in that of ``text``.

    A box of one token counts only when it is the whole value or one of the labels that stand alone.
    """
    def match(needle: Column) -> Column:
        def supports(d: Column) -> Column:
            return (d["tok"].contains(needle) | needle.contains(d["tok"])) & (d["usable"] | (d["tok"] == needle))
        return F.when(F.length(needle) > 2, F.filter(boxes, supports)).otherwise(F.slice(boxes, F.lit(1), F.lit(0)))

    return let(padded_tokens(F.coalesce(text, F.lit(""))), match)


def evidence_struct(boxes: Column, text: Column, fallback: Column) -> Column:
    """Mean confidence (4 places), region ids and text of the support; page average without support; 0 when blank."""
    def summarise(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda a, d: a + F.coalesce(d["confidence"], F.lit(0.0)))
        blank = F.length(strip(F.coalesce(text, F.lit("")))) == 0
        return F.struct(
            F.when(F.size(found) > 0, F.round(total / F.size(found), 4)).when(blank, 0.0).otherwise(fallback).alias("confidence"),
            F.transform(found, lambda d: F.concat(F.lit("region_"), d["pos"].cast("string"))).alias("region_ids"),
            F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda d: strip(d["text"])), "\n"))
            .otherwise(text).alias("raw_text"))
    return let(supporting(boxes, text), summarise)


def evidence_match(docs: DataFrame, values: Column) -> DataFrame:
    """One row per (field, supporting box); ``values`` is an array of (field, value) structs of the document."""
    staged = docs.withColumn("_boxes", tokened(F.col("detections")))
    rows = F.flatten(F.transform(values, lambda v: F.transform(supporting(F.col("_boxes"), v["value"]), lambda d: F.struct(
        v["field"].alias("field"), d["pos"].alias("pos"), d["confidence"].alias("confidence")))))
    return L.emit(staged, rows)


def field_evidence(docs: DataFrame, values: Column) -> DataFrame:
    staged = (docs.withColumn("_boxes", tokened(F.col("detections")))
              .withColumn("_page", L.mean_confidence(F.col("detections"))))
    rows = F.transform(values, lambda v: let(evidence_struct(F.col("_boxes"), v["value"], F.col("_page")), lambda e: F.struct(
        v["field"].alias("field"), v["value"].alias("value"), e["confidence"].alias("confidence"),
        e["region_ids"].alias("region_ids"))))
    return L.emit(staged, rows)


# ---- the field table of a document --------------------------------------------------------------

def _completed_quantity(field: str, also_counts: bool) -> Column:
    """Keyword line of a quantity field, joined with the nearby line that holds the amount."""
    lines = L.line_col()

    def readable(s: Column) -> Column:
        ok = M.quantity_amount(s).isNotNull()
        return ok | M.package_count(s).isNotNull() if also_counts else ok

    def complete(k: Column) -> Column:
        line = F.get(lines, k)
        nearby = L.index_near(lines, k, readable, excluded=L.neighbour_flags(lines, P.NUTRITION_ROW))
        return F.when(k.isNotNull(), F.when(readable(line), line).otherwise(F.concat_ws(" ", line, F.get(lines, nearby))))

    return let(L.keyword_index(field), complete)


def _price_value() -> Column:
    """A labelled price with an amount; without a label, a lone currency amount that is no unit price."""
    lines = L.line_col()
    text = F.array_join(lines, "\n")
    lone = (F.size(F.regexp_extract_all(text, F.lit(P.java(P.CURRENCY_AMOUNT)), F.lit(0))) == 1) & ~has(
        text, r"unit\s+sale|price\s+per|/kg|/g|/l")
    unlabelled = F.when(lone, F.get(lines, L.keyword_index("maximum_retail_price_mrp")))

    def labelled(price: Column) -> Column:
        full = L.append_supporting(price, lines, P.TAX_WORDING)
        return F.when(price.isNotNull(), F.when(F.size(M.amounts(price)) > 0, full)).otherwise(unlabelled)

    return let(L.price_line(lines), labelled)


def _care_parts() -> Column:
    """Name, address, contacts and evidence text of the consumer-care declaration; NULL when none is found."""
    lines = L.line_col()

    def build(start: Column, lead: Column) -> Column:
        line = F.get(lines, start)
        found = let(F.coalesce(L.spatial_contacts_value(L.box_col(), line), L.line_contacts_value(lines, start)), lambda c: c)
        name = L.care_name(F.when(lead.isNotNull(), F.concat(F.lit("Consumer "), line)).otherwise(line))
        block = L.care_block_value(lines, start)

        def assemble(v: Column) -> Column:
            near = F.slice(lines, start + 1, F.lit(P.CARE_CONTACT_LINES))
            contact_lines = F.filter(near, lambda s: F.coalesce(s.contains(v["c"]["telephone_number"]), F.lit(False))
                                     | F.coalesce(s.contains(v["c"]["email_address"]), F.lit(False))
                                     | has(s, P.CARE_ADDRESS_REFERENCE))
            maker = first_where(F.col("roles"), lambda r: r["role"] == "manufacturer")["value"]

            def finish(own: Column, cited: Column) -> Column:
                return F.struct(
                    v["name"].alias("name"), F.coalesce(own, strip(F.regexp_replace(cited, P.java(P.MANUFACTURER_LEAD_IN), ""))).alias("address"),
                    v["c"]["telephone_number"].alias("telephone_number"), v["c"]["email_address"].alias("email_address"),
                    F.concat_ws("\n", lead, line, v["block"], F.array_join(contact_lines, "\n"), cited).alias("evidence"))

            def with_reference(own: Column) -> Column:
                refers = F.when(own.isNull(), F.exists(near, lambda s: has(s, P.CARE_ADDRESS_REFERENCE)))
                return let(F.when(refers, maker), lambda cited: finish(own, cited))

            return let(L.care_address(v["block"], v["name"]), with_reference)

        return let(F.struct(found.alias("c"), name.alias("name"), block.alias("block")), assemble)

    def locate(start: Column) -> Column:
        split = L.paired_heading_value(lines)
        return (F.when(start.isNotNull(), build(start, F.lit(None).cast("string")))
                .otherwise(let(split, lambda p: F.when(p.isNotNull(), build(p["second_line"], F.get(lines, p["first_line"]))))))

    return let(L.care_start(lines), locate)


def extract_fields(docs: DataFrame, *keep: str) -> DataFrame:
    """The field table: one row per document and declared field, with evidence. A projection, no shuffle."""
    return L.emit(with_fields(docs), F.col("fields"), "doc_id", *keep)


ENTITY_FIELDS = ("manufacturer_packer_importer_details", "name_and_address_of_manufacturer_or_packer")
NAME_FIELDS = ("common_generic_name_of_commodity", "identity_of_commodity")
CARE_FIELD = "consumer_care_details"


def with_fields(docs: DataFrame, only: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``fields``: the declared fields of a document as an array in its row.

    ``only`` names the fields that are wanted; what the others need is not computed. ``keep`` names what else of the row
    stays: ``roles`` (where a field needs them), ``_boxes`` with their tokens, ``_page`` for the page's confidence.
    """
    lines = L.line_col()
    asked = lambda *names: only is None or any(n in only for n in names)
    staged = docs.withColumn("_boxes", tokened(L.box_col())).withColumn("_page", L.mean_confidence(L.box_col()))
    if asked(*ENTITY_FIELDS, CARE_FIELD):
        staged = L.role_array(staged, use_layout=True)
    if asked(CARE_FIELD):
        staged = staged.withColumn("_care", _care_parts())
    if asked(*NAME_FIELDS):
        staged = staged.withColumn("_items", L.component_array(lines, L.box_col()))
    items = F.array_join(F.transform("_items", lambda c: F.concat_ws(" ", c["name"], c["quantity"])), "; ")
    descriptive = F.coalesce(F.nullif(items, F.lit("")), F.get(lines, L.identity_index(lines)))
    entity = F.when(F.size("roles") > 0, F.array_join(F.transform("roles", lambda r: r["value"]), " | "))
    none = F.lit(None).cast("string")

    def text_field(name: str, value: Column, factor: Column | float = 1.0) -> Column:
        factor = F.lit(factor) if isinstance(factor, float) else factor
        return let(value, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"), v.alias("evidence"), factor.alias("factor")))

    def named_field(name: str) -> Column:
        return let(F.get(lines, L.keyword_index(name)), lambda literal: F.struct(
            F.lit(name).alias("field"), F.coalesce(literal, F.col("_name")).alias("value"),
            F.coalesce(literal, F.col("_name")).alias("evidence"),
            F.when(literal.isNull(), NAME_FACTOR).otherwise(1.0).alias("factor")))

    if asked(*NAME_FIELDS):
        staged = staged.withColumn("_name", descriptive)
    build = {
        "country_of_origin": lambda n: text_field(n, let(L.country_text(lines), lambda c: F.coalesce(
            F.when(M.country_remainder(c).isNull(), L.spatial_pair_value(L.box_col())["value"]), c))),
        "common_generic_name_of_commodity": named_field,
        "net_quantity": lambda n: text_field(n, _completed_quantity(n, False)),
        "month_and_year_of_manufacture_or_packing": lambda n: text_field(n, F.get(lines, L.date_near_index(lines))),
        "maximum_retail_price_mrp": lambda n: text_field(n, _price_value()),
        "unit_sale_price": lambda n: text_field(n, F.get(lines, L.keyword_index(n))),
        "manufacturer_packer_importer_details": lambda n: text_field(n, entity),
        "name_and_address_of_manufacturer_or_packer": lambda n: text_field(n, entity),
        "identity_of_commodity": named_field,
        "total_number_of_retail_packages_or_net_quantity": lambda n: text_field(n, _completed_quantity(n, True)),
        CARE_FIELD: lambda n: F.struct(F.lit(n).alias("field"), F.col("_care")["address"].alias("value"),
                                       F.col("_care")["evidence"].alias("evidence"), F.lit(1.0).alias("factor")),
    }
    texts = F.array(*[make(name) for name, make in build.items() if asked(name)])

    def resolve(t: Column) -> Column:
        is_care = t["field"] == CARE_FIELD

        def care(part: str) -> Column:
            value = F.when(is_care, F.col("_care")[part]) if asked(CARE_FIELD) else none
            return value.alias(f"care_{part}")

        return let(evidence_struct(F.col("_boxes"), t["evidence"], F.col("_page")), lambda e: F.struct(
            t["field"].alias("field"), t["value"].alias("value"), t["evidence"].isNotNull().alias("detected"),
            F.when(t["evidence"].isNotNull(), e["confidence"] * t["factor"]).otherwise(0.0).alias("confidence"),
            e["region_ids"].alias("region_ids"), e["raw_text"].alias("raw_text"),
            care("name"), care("address"), care("telephone_number"), care("email_address")))

    staged = staged.withColumn("_texts", texts).withColumn("fields", F.transform("_texts", resolve))
    return staged.select(*docs.columns, *keep, "fields")


# ---- overlays -----------------------------------------------------------------------------------

def best_regions(regions: DataFrame) -> DataFrame:
    """Per document and class the region detected with most confidence, the earliest on ties; one partial aggregate.

    A region without a detection confidence counts as 0; one without a class is left out.
    """
    order = F.struct(F.coalesce("detection_confidence", F.lit(0.0)), -F.col("pos"))
    best = regions.where("class_name is not null").groupBy("doc_id", "class_name").agg(
        F.max_by(F.struct("full_text", "confidence"), order).alias("_r"))
    return best.select("doc_id", "class_name", F.nullif(strip(F.col("_r.full_text")), F.lit("")).alias("text"), F.col("_r.confidence").alias("confidence"))


def overlay_regions(fields: DataFrame, regions: DataFrame) -> DataFrame:
    """The best region of a class overrides the fields of its class, also with nothing when it holds no text.

    ``fields(doc_id, field, value, confidence)``, ``regions(doc_id, pos, class_name, detection_confidence,
    full_text, confidence)``. A region's border is the border of its block, so the text of a care region is its address
    whole, with the first telephone number and e-mail address in it. Regions of an unknown class change nothing.
    """
    mapping = F.create_map(*[x for c, fs in P.REGION_CLASS_FIELDS.items()
                             for x in (F.lit(c), F.array(*[F.lit(f) for f in fs]))])
    care = F.col("class_name") == "consumer_care"
    evidence = F.when(F.col("text").isNotNull(), F.array(F.concat(F.lit(P.REGION_ID_PREFIX), "class_name"))).otherwise(F.expr("cast(array() as array<string>)"))
    overlay = (best_regions(regions).withColumn("field", F.explode_outer(F.try_element_at(mapping, F.col("class_name"))))
               .where("field is not null")
               .select("doc_id", "field", F.col("text").alias("_value"), F.col("confidence").alias("_confidence"), evidence.alias("_ids"),
                       F.when(care, F.col("text")).alias("care_address"),
                       F.when(care, group(F.col("text"), P.PHONE, 0)).alias("care_telephone_number"),
                       F.when(care, group(F.col("text"), P.EMAIL, 0)).alias("care_email_address"), F.lit(True).alias("_over")))
    joined = fields.select("doc_id", "field", "value", "confidence").join(overlay, ["doc_id", "field"], "full_outer")
    over = F.col("_over").isNotNull()
    value = F.when(over, F.col("_value")).otherwise(F.col("value"))
    return joined.select("doc_id", "field", value.alias("value"), value.isNotNull().alias("detected"),
                         F.when(over, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"),
                         F.coalesce("_ids", F.expr("cast(array() as array<string>)")).alias("region_ids"),
                         "care_address", "care_telephone_number", "care_email_address",
                         F.when(over, "region").otherwise("page").alias("source"))


def region_metadata(regions: DataFrame) -> DataFrame:
    """Batch number and expiry read from the date region of each document; a document whose region states neither is left out."""
    dates = best_regions(regions.where("class_name = 'mfg_date_batch'"))
    read = dates.select("doc_id", group(F.col("text"), P.REGION_BATCH).alias("batch_lot_number"),
                        strip(group(F.col("text"), P.REGION_EXPIRY)).alias("expiry_or_best_before_date"))
    return read.where("batch_lot_number is not null or expiry_or_best_before_date is not null")


def overlay_supplied(fields: DataFrame, supplied: DataFrame, page: DataFrame) -> DataFrame:
    """Supplied values override; a value without its own confidence takes the page's."""
    given = (supplied.join(page, "doc_id", "left")
             .select("doc_id", "field", F.col("value").alias("_value"), F.lit(True).alias("_over"),
                     F.coalesce("confidence", "page_confidence", F.lit(0.0)).alias("_confidence")))
    joined = fields.join(given, ["doc_id", "field"], "full_outer")
    over = F.col("_over").isNotNull()
    return joined.select("doc_id", "field",
                         F.when(over, F.col("_value")).otherwise(F.col("value")).alias("value"),
                         F.when(over, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"))


def overlay_suggestions(fields: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Suggested values fan out to the fields of their class; a price suggestion is given its wording."""
    mapping = F.create_map(*[x for c, fs in P.REGION_CLASS_FIELDS.items()
                             for x in (F.lit(c), F.array(*[F.lit(f) for f in fs]))])
    worded = F.when((F.col("class_name") == "mrp") & ~has(F.col("value"), P.PRICE_LABEL),
                    F.concat(F.lit("MRP "), F.col("value"))).otherwise(F.col("value"))
    proposed = (suggestions.select("doc_id", worded.alias("_value"), F.col("confidence").alias("_confidence"),
                                   F.explode_outer(F.try_element_at(mapping, F.col("class_name"))).alias("field"))
                .where("field is not null"))
    joined = fields.join(proposed, ["doc_id", "field"], "full_outer")
    over = F.col("_confidence").isNotNull()
    return joined.select("doc_id", "field",
                         F.when(over, F.col("_value")).otherwise(F.col("value")).alias("value"),
                         F.when(over, F.col("_confidence")).otherwise(F.col("confidence")).alias("confidence"),
                         F.when(over, "suggested").otherwise("page").alias("source"))


def ambiguous_fields(docs: DataFrame, fields: DataFrame, threshold: float = P.FIELD_CONFIDENCE, k: int = 4) -> DataFrame:
    """Per document the first k declaration classes, in fixed order, that are missing or of low confidence."""
    classes = list(P.REGION_CLASS_FIELDS)
    held = fields.groupBy("doc_id").agg(*[
        F.bool_or((F.col("field") == P.REGION_CLASS_FIELDS[c][0]) & (F.col("confidence") >= threshold)).alias(c) for c in classes])
    joined = docs.select("doc_id").join(held, "doc_id", "left")
    unsure = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in classes]))
    return L.emit(joined.withColumn("_u", F.slice(unsure, 1, k)),
                  F.transform("_u", lambda c, i: F.struct((i + 1).alias("ord"), c.alias("class_name"))))


# ---- structured view ----------------------------------------------------------------------------

def structured_extraction(docs: DataFrame) -> DataFrame:
    """Leaves of the structured view: parsed value, raw text, recognition and extraction confidence."""
    lines = L.line_col()
    paths = {"maximum_retail_price_mrp": "pricing.maximum_retail_price_mrp", "unit_sale_price": "pricing.unit_sale_price",
             "net_quantity": "quantity", "country_of_origin": "origin.country_of_origin",
             "month_and_year_of_manufacture_or_packing": "dates.manufacture_or_packing_date",
             "common_generic_name_of_commodity": "product.name", "consumer_care_details": "consumer_care.details"}
    staged = with_fields(docs, list(paths), keep=("roles", "_boxes", "_page"))
    care_parts = ("care_name", "care_address", "care_telephone_number", "care_email_address")
    # Fields and other leaves leave a document in one array, so each document is read and its boxes and roles are made once.
    columns = ("field", "path", "value", "raw_text", "ocr_confidence", "extraction_confidence", *care_parts)
    kinds = {"ocr_confidence": "double", "extraction_confidence": "double"}

    def row(**given: Column) -> Column:
        return F.struct(*[given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in columns])

    wanted = F.filter("fields", lambda f: f["detected"] & f["field"].isin(*paths))
    from_fields = F.transform(wanted, lambda f: row(field=f["field"], value=f["value"], raw_text=f["raw_text"], ocr_confidence=f["confidence"],
                                                    **{c: f[c] for c in care_parts}))

    def leaf(path_name: str, v: Column, certainty_value: float) -> Column:
        conf = evidence_struct(F.col("_boxes"), v, F.lit(0.0))["confidence"]
        return F.when(v.isNotNull(), row(path=F.lit(path_name), value=v, raw_text=v, ocr_confidence=conf, extraction_confidence=F.lit(certainty_value)))

    def role_leaf(r: Column) -> Column:
        bare = has(r["value"], P.HEADING_ONLY)
        return row(path=F.concat(F.lit("business_details."), r["role"]), value=F.when(~bare, r["value"]), raw_text=r["value"],
                   ocr_confidence=evidence_struct(F.col("_boxes"), r["value"], F.col("_page"))["confidence"],
                   extraction_confidence=F.when(bare, 0.0).otherwise(0.9))

    barcode = first_where(lines, lambda s: has(s, P.BARCODE_LINE))
    licence = group(F.array_join(lines, "\n"), P.LICENCE)
    warnings = F.array_distinct(F.filter(lines, lambda s: has(s, P.WARNING)))
    single = F.array(let(barcode, lambda v: leaf("identification.barcode", v, 0.7)), let(licence, lambda v: leaf("food_information.licence", v, 0.95)))
    leaves = L.emit(staged, F.concat(from_fields, single, F.transform("roles", role_leaf), F.transform(warnings, lambda w: leaf("warnings", w, 0.8))))

    is_field = F.col("field").isNotNull()
    date_token = group(F.col("value"), P.DATE, 0)
    amount = F.when(F.col("field") == "unit_sale_price", M.unit_price_amount(F.col("value"))).otherwise(
        M.amount_value(F.get(M.amounts(F.col("value")), F.lit(0))))
    is_money = F.col("field").isin("maximum_retail_price_mrp", "unit_sale_price")
    value = (F.when(is_money, amount.cast("string"))
             .when(F.col("field") == "net_quantity", F.concat_ws(" ", group(F.col("value"), P.QUANTITY, 1),
                                                                 M.normal_unit(group(F.col("value"), P.QUANTITY, 2))))
             .when(F.col("field") == "month_and_year_of_manufacture_or_packing", date_token)
             .when(F.col("field") == "consumer_care_details", F.concat_ws("; ", *care_parts))
             .otherwise(F.col("value")))
    worded = (F.col("field") == "unit_sale_price") | has(F.col("value"), P.PRICE_LABEL)
    certainty = (F.when(~is_field, F.col("extraction_confidence"))
                 .when(is_money, F.when(amount.isNull(), 0.0).when(worded, 0.95).otherwise(0.6))
                 .when(F.col("field") == "net_quantity", F.when(M.quantity_amount(F.col("value")).isNotNull(), 0.95).otherwise(0.0))
                 .when(F.col("field") == "month_and_year_of_manufacture_or_packing", F.when(date_token.isNotNull(), 0.9).otherwise(0.3))
                 .when(F.col("field") == "common_generic_name_of_commodity", 0.75)
                 .when(F.col("field") == "consumer_care_details", F.when(
                     F.col("care_telephone_number").isNotNull() | F.col("care_email_address").isNotNull(), 0.9).otherwise(0.6))
                 .otherwise(0.9))
    return leaves.select("doc_id", F.coalesce("path", lookup(paths, F.col("field"))).alias("path"),
                         F.when(is_field, F.nullif(value, F.lit(""))).otherwise(F.col("value")).alias("value"), "raw_text", "ocr_confidence", certainty.alias("extraction_confidence"))


def overall_confidence(leaves: DataFrame) -> DataFrame:
    """Mean recognition confidence over populated leaves only."""
    return leaves.groupBy("doc_id").agg(
        F.round(F.coalesce(F.avg(F.when(F.col("value").isNotNull(), F.col("ocr_confidence"))), F.lit(0.0)), 4).alias("overall_confidence"),
        F.count("value").alias("populated"))


def words_to_lines(words: DataFrame) -> DataFrame:
    """Words ``(doc_id, block, par, line, word, text, conf, left, top, width, height)`` to line boxes."""
    text = strip(F.col("text"))
    usable = words.where((F.length(text) > 0) & (F.col("conf") >= 0) & (F.col("width") > 0) & (F.col("height") > 0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", text.alias("t")))), lambda w: w["t"]), " ")
    return usable.groupBy("doc_id", "block", "par", "line").agg(
        joined.alias("text"), (F.avg(F.least("conf", F.lit(100.0))) / 100).alias("confidence"),
        F.min("left").alias("x1"), F.min("top").alias("y1"),
        F.max(F.col("left") + F.col("width")).alias("x2"), F.max(F.col("top") + F.col("height")).alias("y2"))
