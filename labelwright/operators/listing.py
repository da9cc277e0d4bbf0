"""Product fields from web pages: page parts, structured data, meta tags, labelled lines, priority resolution.

A page is one row and its parts are arrays in that row, so extraction is a projection until the final rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions.entities import unescape
from labelwright.functions.text import blank_to_null, first_where, group, has, let, lookup, strip
from labelwright.operators.lines import emit

# Admission limits, labels and the fields of a listing.
CONTENT_TYPES = ("text/html", "application/xhtml+xml")
MAX_BYTES = 2 * 1024 * 1024
MIN_VISIBLE_CHARS = 40
LISTING_FIELDS = ["product_name", "brand", "price", "mrp", "net_quantity", "country_of_origin", "manufacturer",
                  "packer_importer", "consumer_care"]
PROPERTY_FIELDS = {"country of origin": "country_of_origin", "made in": "country_of_origin", "net quantity": "net_quantity",
                   "net weight": "net_quantity", "net wt": "net_quantity", "manufacturer": "manufacturer", "manufactured by": "manufacturer",
                   "packed by": "packer_importer", "imported by": "packer_importer", "importer": "packer_importer",
                   "consumer care": "consumer_care", "customer care": "consumer_care", "mrp": "mrp", "maximum retail price": "mrp"}
LABEL_PATTERNS = {
    "country_of_origin": r"^\s*(?:country\s*of\s*origin|made\s*in|product\s*of)\s*[:\-]\s*(.{2,80})$",
    "net_quantity": r"^\s*net\s*(?:quantity|weight|qty|wt\.?)\s*[:\-]\s*(.{1,60})$",
    "manufacturer": r"^\s*(?:manufactured\s*by|manufacturer|marketed\s*by)\s*[:\-]\s*(.{2,200})$",
    "packer_importer": r"^\s*(?:packed\s*by|imported\s*by|importer)\s*[:\-]\s*(.{2,200})$",
    "consumer_care": r"^\s*(?:consumer\s*care|customer\s*care)\s*[:\-]\s*(.{2,200})$",
    "mrp": r"^\s*(?:m\.?\s*r\.?\s*p\.?|maximum\s*retail\s*price)\s*[:\-]?\s*(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)",
}
# What is no text: scripts, styles, the title, comments, declarations and instructions, also when they are never closed.
HIDDEN = (r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<title\b.*?</title\s*>|<!--.*?(?:-->|\z)|<![^>]*>|<\?[^>]*>")
# A tag begins with a letter; a greater-than sign within a quoted value does not end it.
TAG = r"""</[a-zA-Z][^>]*>|<[a-zA-Z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|<[a-zA-Z][^>]*>"""


def admit_pages(pages: DataFrame) -> DataFrame:
    """Admission of fetched pages ``(page_id, html, http_status, content_type, declared_length)`` with a status."""
    kind = F.lower(strip(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    status = (F.when(F.col("http_status") >= 400, "HTTP_ERROR").when(~kind.isin(*CONTENT_TYPES), "UNSUPPORTED_CONTENT_TYPE")
              .when((F.coalesce("declared_length", F.lit(0)) > MAX_BYTES) | (size > MAX_BYTES), "RESPONSE_TOO_LARGE")
              .when(size == 0, "EMPTY_RESPONSE").otherwise("SUCCESS"))
    return pages.withColumn("retrieval_status", status)


def page_parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, meta map, JSON-LD blocks and visible text pieces."""
    h = F.col(html)
    title = blank_to_null(unescape(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    tags = F.regexp_extract_all(h, F.lit(r"""(?is)(<meta\b(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|<meta\b[^>]*>)"""), F.lit(1))
    # double-quoted, single-quoted and bare values, each in a group of its own
    attribute = lambda tag, name: F.concat(*[F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", i) for i in (1, 2, 3)])
    key = lambda tag: F.lower(strip(F.coalesce(F.nullif(attribute(tag, "property"), F.lit("")), attribute(tag, "name"))))
    entries = F.filter(F.transform(tags, lambda tag: F.struct(key(tag).alias("key"), unescape(attribute(tag, "content")).alias("value"))),
                       lambda e: (F.length(e["key"]) > 0) & (F.length(e["value"]) > 0))
    blocks = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)),
                      lambda b: F.length(b) > 0)
    visible = F.regexp_replace(h, HIDDEN, "\u0001")
    pieces = F.filter(F.transform(F.split(visible, r"\x01|" + TAG), lambda s: strip(unescape(s))), lambda s: F.length(s) > 0)
    return (pages.withColumn("title", title).withColumn("meta", F.map_from_entries(_last_per_key(entries)))
            .withColumn("json_blocks", blocks).withColumn("text_lines", pieces))


def _last_per_key(entries: Column) -> Column:
    """The last entry of each key, as repeated tags overwrite earlier ones."""
    start = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    return F.aggregate(entries, start, lambda acc, e: F.concat(F.filter(acc, lambda x: x["key"] != e["key"]), F.array(e)))


def json_nodes(block: Column) -> Column:
    """Objects of a JSON block: the object itself, the items of an array, and the items of ``@graph``."""
    trimmed = strip(block)
    as_list = F.when(trimmed.startswith("["), F.from_json(trimmed, "array<string>")).otherwise(F.array(trimmed))
    graph = lambda node: F.coalesce(F.from_json(F.get_json_object(node, "$.@graph"), "array<string>"), F.expr("cast(array() as array<string>)"))
    return F.flatten(F.transform(F.coalesce(as_list, F.expr("cast(array() as array<string>)")), lambda n: F.concat(F.array(n), graph(n))))


def product_nodes(blocks: Column) -> Column:
    """Product objects of all readable blocks, in page order; ``@type`` may be a name or a list of names."""
    readable = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
    is_product = lambda n: F.lower(F.coalesce(F.get_json_object(n, "$.@type"), F.lit(""))).contains("product")
    return F.filter(F.flatten(F.transform(readable, json_nodes)), is_product)


def named(node: Column, path: str) -> Column:
    """A name given as text, as an object with a name, or as the first of a list of either."""
    raw = F.get_json_object(node, f"$.{path}")
    first = F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)
    return blank_to_null(F.when(first.startswith("{"), F.get_json_object(first, "$.name")).otherwise(first))


def jsonld_field_array(node: Column) -> Column:
    """(field, value) structs of one product object."""
    offers = F.get_json_object(node, "$.offers")
    offer = F.when(offers.startswith("["), F.get(F.from_json(offers, "array<string>"), F.lit(0))).otherwise(offers)
    amount = F.coalesce(F.get_json_object(offer, "$.price"), F.get_json_object(offer, "$.lowPrice"))
    currency = F.coalesce(F.get_json_object(offer, "$.priceCurrency"), F.lit(""))
    price = F.when(amount.isNotNull(), strip(F.concat_ws(" ", currency, amount)))
    props = F.get_json_object(node, "$.additionalProperty")
    listed = F.when(props.startswith("["), F.from_json(props, "array<string>")).when(props.startswith("{"), F.array(props))
    none = F.expr("cast(array() as array<struct<field:string,value:string>>)")
    pair = lambda field, value: F.struct(field.alias("field"), value.alias("value"))
    extra = F.transform(listed, lambda p: pair(lookup(PROPERTY_FIELDS, F.lower(strip(F.get_json_object(p, "$.name")))),
                                               blank_to_null(F.get_json_object(p, "$.value"))))
    fixed = F.array(*[pair(F.lit(f), named(node, path)) for f, path in (
        ("product_name", "name"), ("brand", "brand"), ("manufacturer", "manufacturer"), ("country_of_origin", "countryOfOrigin"))],
        pair(F.lit("price"), price))
    return F.filter(F.concat(fixed, F.coalesce(extra, none)), lambda e: e["field"].isNotNull() & e["value"].isNotNull())


def jsonld_products(parts: DataFrame) -> DataFrame:
    """First product object per page, how many there were, and how many blocks could not be read."""
    staged = parts.withColumn("_n", product_nodes(F.col("json_blocks"))).withColumn(
        "bad_blocks", F.size(F.filter("json_blocks", lambda b: F.try_parse_json(b).isNull())))
    return staged.select("page_id", F.size("_n").alias("products"), "bad_blocks", F.get("_n", F.lit(0)).alias("node"))


def jsonld_fields(parts: DataFrame) -> DataFrame:
    first = parts.withColumn("_node", F.get(product_nodes(F.col("json_blocks")), F.lit(0)))
    return emit(first, F.transform(jsonld_field_array(F.col("_node")), lambda e, i: F.struct(
        i.alias("ord"), e["field"].alias("field"), e["value"].alias("value"))), "page_id")


def meta_field_array(meta: Column) -> Column:
    get = lambda k: blank_to_null(F.try_element_at(meta, F.lit(k)))
    currency = F.coalesce(F.try_element_at(meta, F.lit("product:price:currency")), F.try_element_at(meta, F.lit("og:price:currency")), F.lit(""))
    amount = F.coalesce(get("product:price:amount"), get("og:price:amount"))
    found = F.array(F.struct(F.lit("product_name").alias("field"), get("og:title").alias("value")),
                    F.struct(F.lit("brand").alias("field"), F.coalesce(get("og:brand"), get("product:brand")).alias("value")),
                    F.struct(F.lit("price").alias("field"), F.when(amount.isNotNull(), strip(F.concat_ws(" ", currency, amount))).alias("value")))
    return F.filter(found, lambda e: e["value"].isNotNull())


def meta_fields(parts: DataFrame) -> DataFrame:
    return emit(parts, meta_field_array(F.col("meta")), "page_id")


def label_field_array(lines: Column) -> Column:
    """First labelled value per field; a quantity must look like one."""
    def value(field: str, pattern: str) -> Column:
        read = lambda s: F.nullif(F.regexp_replace(strip(group(s, pattern)), r"[.,;]+$", ""), F.lit(""))
        ok = (lambda v: has(v, P.QUANTITY_LIKE)) if field == "net_quantity" else (lambda v: v.isNotNull())
        hits = F.filter(F.transform(F.filter(lines, lambda s: has(s, pattern)), read), lambda v: v.isNotNull() & ok(v))
        return F.struct(F.lit(field).alias("field"), F.get(hits, F.lit(0)).alias("value"))
    return F.filter(F.array(*[value(f, p) for f, p in LABEL_PATTERNS.items()]), lambda e: e["value"].isNotNull())


def label_fields(parts: DataFrame) -> DataFrame:
    return emit(parts, label_field_array(F.col("text_lines")), "page_id")


def resolve_by_priority(parts: DataFrame) -> DataFrame:
    """Per page one row per field with its source: structured data, meta tags, labelled text, page title."""
    source = lambda arr, name: F.transform(arr, lambda e: F.struct(e["field"].alias("field"), e["value"].alias("value"), F.lit(name).alias("source")))
    staged = parts.withColumn("_node", F.get(product_nodes(F.col("json_blocks")), F.lit(0)))
    title = F.filter(F.array(F.struct(F.lit("product_name").alias("field"), F.col("title").alias("value"), F.lit("page-title").alias("source"))),
                     lambda e: e["value"].isNotNull())
    none = F.expr("cast(array() as array<struct<field:string,value:string,source:string>>)")
    candidates = F.concat(F.coalesce(source(jsonld_field_array(F.col("_node")), "json-ld"), none), source(meta_field_array(F.col("meta")), "meta-tag"),
                          source(label_field_array(F.col("text_lines")), "text-label"), title)
    staged = staged.withColumn("_cands", candidates)
    rows = F.transform(F.array(*[F.lit(f) for f in LISTING_FIELDS]), lambda f: let(
        first_where(F.col("_cands"), lambda c: c["field"] == f), lambda c: F.struct(f.alias("field"), c["value"].alias("value"), c["source"].alias("source"))))
    return emit(staged, rows, "page_id")


def listing_rows(parts: DataFrame) -> DataFrame:
    """One listing row per page, or LISTING_UNAVAILABLE when nothing can be read."""
    chars = F.aggregate("text_lines", F.lit(0), lambda a, s: a + F.length(s))
    signal = (F.size("json_blocks") > 0) | F.coalesce(F.try_element_at("meta", F.lit("og:title")), F.try_element_at("meta", F.lit("product:price:amount")),
                                                      F.try_element_at("meta", F.lit("og:price:amount"))).isNotNull()
    state = parts.select("page_id", F.when(~signal & (chars < MIN_VISIBLE_CHARS), "LISTING_UNAVAILABLE").otherwise("SUCCESS").alias("retrieval_status"))
    wide = resolve_by_priority(parts).groupBy("page_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in LISTING_FIELDS],
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("value").isNull(), F.col("field")))), ",").alias("unavailable"))
    return state.join(wide, "page_id")


def flat_metadata(parts: DataFrame) -> DataFrame:
    """Name, brand and price of the first readable JSON object of a page."""
    readable = F.filter("json_blocks", lambda b: F.try_parse_json(b).isNotNull())
    node = F.get(F.filter(F.flatten(F.transform(readable, lambda b: F.when(strip(b).startswith("["), F.from_json(strip(b), "array<string>")).otherwise(F.array(b)))),
                          lambda n: strip(n).startswith("{")), F.lit(0))
    staged = parts.withColumn("_n", node)
    get = lambda p: F.get_json_object("_n", p)
    plain = lambda c: blank_to_null(F.when(~c.startswith("{") & ~c.startswith("["), c))
    name = F.coalesce(plain(get("$.name")), plain(get("$.itemName")), plain(get("$.title")))
    brand = F.coalesce(plain(get("$.brand")), blank_to_null(get("$.brand.name")))
    price = F.coalesce(blank_to_null(get("$.offers.price")), plain(get("$.price")))
    return staged.where("_n is not null").select("page_id", name.alias("product_name"), brand.alias("brand"), price.alias("price"))
