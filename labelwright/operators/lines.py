"""Extraction over the lines of a document.

A document is one row with its lines (and boxes) in arrays, so every operator here is a projection: no
shuffle and no window, whatever the number of documents, and one busy source cannot skew anything.
``docs`` always carries ``doc_id`` and ``lines array<string>``; layout operators also need
``detections array<struct<pos,text,confidence,x1,y1,x2,y2>>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions import measures as M
from labelwright.functions import patterns as P
from labelwright.functions.text import (
    all_of, any_of, blank_to_null, first_where, group, has, index_containing, index_matching, index_of, let, strip, to_line_array, tokens, window_after,
)

def line_col() -> Column:
    return F.col("lines")


def box_col() -> Column:
    return F.col("detections")


# ---- lines in and out ---------------------------------------------------------------------------

def to_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Dense, stripped, non-empty lines of each document."""
    arrays = docs.select("doc_id", to_line_array(F.col(text)).alias("lines"))
    return explode_lines(arrays)


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("lines", to_line_array(F.col(text)))


def emit(docs: DataFrame, rows: Column, *keep: str) -> DataFrame:
    """One output row per struct of an array; NULL structs are dropped.

    The outer form keeps Spark from deriving a filter on the array and running the whole expression twice.
    """
    present = F.transform(rows, lambda r: F.struct(r.isNotNull().alias("_row"), r.alias("_value")))
    out = docs.select(*(keep or ("doc_id",)), F.inline_outer(present)).where(F.col("_row"))
    return out.select(*(keep or ("doc_id",)), "_value.*")


def emit_one(docs: DataFrame, index: Column, row: Callable[[Column], Column]) -> DataFrame:
    """One row per document where ``index`` is known, computed once."""
    return emit(docs, F.array(let(index, lambda k: F.when(k.isNotNull(), row(k)))))


def explode_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer("lines").alias("n", "text")).where("n is not null")


def to_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.array_join("lines", "\n"))


def page_confidence(docs: DataFrame) -> DataFrame:
    return docs.withColumn("page_confidence", mean_confidence(box_col()))


def mean_confidence(detections: Column) -> Column:
    total = F.aggregate(detections, F.lit(0.0), lambda acc, d: acc + F.coalesce(d["confidence"], F.lit(0.0)))
    return F.when(F.size(detections) > 0, total / F.size(detections)).otherwise(F.lit(0.0))


# ---- keyword lines ------------------------------------------------------------------------------

def _pattern_index(lines: Column, expressions: list[str]) -> Column:
    return F.coalesce(*[index_matching(lines, p) for p in expressions])


def _keyword_rows(docs: DataFrame, found: list[tuple[str, Column]]) -> DataFrame:
    def row(field: str, hit: Column) -> Column:
        return let(hit, lambda h: F.when(h["n"].isNotNull(), F.struct(
            F.lit(field).alias("field"), h["n"].alias("n"), F.get(F.col("lines"), h["n"]).alias("text"), h["source"].alias("source"))))
    return emit(docs, F.array_compact(F.array(*[row(field, hit) for field, hit in found])))


def _hit(index: Column, source: str) -> Column:
    return F.struct(index.alias("n"), F.lit(source).alias("source"))


def match_aliases(docs: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Per field the first alias in list order that any line holds, and the first line holding it."""
    aliases = aliases or P.FIELD_ALIASES
    return _keyword_rows(docs, [(f, _hit(index_containing(line_col(), a), "literal")) for f, a in aliases.items()])


def match_keywords(docs: DataFrame, aliases: dict[str, list[str]] | None = None,
                   expressions: dict[str, list[str]] | None = None) -> DataFrame:
    """As ``match_aliases``; fields without a literal alias fall back to patterns in list order."""
    aliases, expressions = aliases or P.FIELD_ALIASES, expressions or P.FIELD_PATTERNS

    def hit(field: str, literals: list[str]) -> Column:
        literal = index_containing(line_col(), literals)
        if field not in expressions:
            return _hit(literal, "literal")
        fallback = _hit(_pattern_index(line_col(), expressions[field]), "pattern")
        return let(literal, lambda k: F.when(k.isNotNull(), _hit(k, "literal")).otherwise(fallback))

    return _keyword_rows(docs, [(field, hit(field, literals)) for field, literals in aliases.items()])


def keyword_index(field: str) -> Column:
    literal = index_containing(line_col(), P.FIELD_ALIASES[field])
    fallback = P.FIELD_PATTERNS.get(field)
    return F.coalesce(literal, _pattern_index(line_col(), fallback)) if fallback else literal


# ---- values near a keyword ----------------------------------------------------------------------

def neighbour_flags(lines: Column, pattern: str, radius: int = 1) -> Column:
    """Per line, whether another line within ``radius`` matches the pattern."""
    return let(F.transform(lines, lambda s: has(s, pattern)), lambda hits: F.transform(hits, lambda _h, i: any_of(
        [F.coalesce(F.get(hits, i + d), F.lit(False)) for r in range(1, radius + 1) for d in (-r, r)])))


def index_near(lines: Column, start: Column, test, ahead: int = P.NEARBY_LINES, excluded: Column | None = None) -> Column:
    """Index of the first line after ``start`` within the window that passes ``test``."""
    def search(k: Column) -> Column:
        passed = F.transform(window_after(lines, k, ahead), lambda s: F.coalesce(test(s), F.lit(False)))
        if excluded is not None:
            passed = F.zip_with(passed, window_after(excluded, k, ahead), lambda ok, out: ok & ~F.coalesce(out, F.lit(False)))
        return let(F.array_position(passed, True), lambda p: F.when(p > 0, k + p.cast("int")))
    return let(start, search)


def value_near(docs: DataFrame, keyword: str, value: str, *, value_group: int = 1, ahead: int = P.NEARBY_LINES,
               skip: str | None = P.DECLARATION_HEADING) -> DataFrame:
    """Value on the first keyword line, else on the first usable line of the window after it."""
    def usable(s: Column) -> Column:
        return has(s, value) & ~has(s, skip) if skip else has(s, value)

    def found(k: Column) -> Column:
        here = F.when(has(F.get(line_col(), k), value), k)
        return let(F.coalesce(here, index_near(line_col(), k, usable, ahead)), lambda v: F.when(v.isNotNull(), F.struct(
            k.alias("keyword_line"), v.alias("value_line"),
            strip(group(F.get(line_col(), v), value, value_group)).alias("value"))))

    return emit_one(docs, index_of(line_col(), lambda s: has(s, keyword)), found)


def date_near_index(lines: Column, window: int = P.NEARBY_LINES) -> Column:
    """First keyword line that has a date on it or within the window either side; the date line's index."""
    def search(dated: Column) -> Column:
        def resolve(s: Column, i: Column) -> Column:
            start = F.greatest(i - window, F.lit(0))
            found = F.array_position(F.slice(dated, start + 1, i + window - start + 1), True)
            near = F.when(found > 0, start + found.cast("int") - 1)
            return F.when(has(s, P.DATE_KEYWORD), F.when(F.get(dated, i), i).otherwise(near))
        return F.get(F.array_compact(F.transform(lines, resolve)), F.lit(0))

    return let(F.transform(lines, lambda s: has(s, P.DATE)), search)


def date_near(docs: DataFrame, window: int = P.NEARBY_LINES) -> DataFrame:
    return emit_one(docs, date_near_index(line_col(), window), _numbered_line)


def _numbered_line(n: Column) -> Column:
    return F.struct(n.alias("n"), F.get(line_col(), n).alias("text"))


def exclude_context(docs: DataFrame, pattern: str = P.NUTRITION_ROW, radius: int = 1) -> DataFrame:
    """Lines none of whose neighbours matches the context vocabulary."""
    rows = F.transform(F.arrays_zip(line_col().alias("text"), neighbour_flags(line_col(), pattern, radius).alias("near")),
                       lambda r, i: F.when(~r["near"], F.struct(i.alias("n"), r["text"].alias("text"))))
    return emit(docs, rows)


def price_line(lines: Column) -> Column:
    """The price declaration: label line, nearby amount, tax wording from anywhere on the page."""
    def complete(start: Column) -> Column:
        label = F.get(lines, start)
        amount = index_near(lines, start, lambda s: M.has_amount(s) | has(s, P.BARE_AMOUNT))
        joined = F.when(M.has_amount(label), label).otherwise(F.concat_ws(" ", label, F.get(lines, amount)))
        return F.when(start.isNotNull(), joined)
    return let(index_matching(lines, P.PRICE_LABEL), complete)


def append_supporting(value: Column, lines: Column, pattern: str) -> Column:
    def append(v: Column) -> Column:
        extra = F.when(v.isNotNull() & ~has(v, pattern), first_where(lines, lambda s: has(s, pattern)))
        return let(extra, lambda e: F.when(e.isNotNull() & ~v.contains(e), F.concat_ws(" ", v, e)).otherwise(v))
    return let(value, append)


def join_supporting_line(docs: DataFrame, pattern: str = P.TAX_WORDING) -> DataFrame:
    """Append the first tax-wording line to the price line where it lacks the wording."""
    return emit_one(docs, price_line(line_col()), lambda price: F.struct(
        append_supporting(price, line_col(), pattern).alias("value")))


# ---- blocks -------------------------------------------------------------------------------------

def block_after(docs: DataFrame, trigger: str = P.INGREDIENTS_TRIGGER, stop: str = P.DECLARATION_HEADING,
                max_lines: int = P.BLOCK_LINES) -> DataFrame:
    """Trigger line and what follows it up to the next heading."""
    def gather(k: Column) -> Column:
        def cut(w: Column) -> Column:
            end = index_of(w, lambda s: has(s, stop) & ~has(s, trigger))
            return F.concat(F.array(F.get(line_col(), k)), F.slice(w, F.lit(1), F.coalesce(end, F.size(w))))
        return let(let(window_after(line_col(), k, max_lines), cut), lambda kept: F.struct(
            k.alias("start_line"), F.size(kept).alias("n_lines"), F.array_join(kept, "\n").alias("block")))

    return emit_one(docs, index_of(line_col(), lambda s: has(s, trigger)), gather)


def care_start(lines: Column) -> Column:
    return index_matching(lines, P.CARE_TRIGGER)


def care_block_value(lines: Column, start: Column) -> Column:
    """Care heading and up to three lines; fragments are skipped, another declaration stops it."""
    following = window_after(lines, start, P.CARE_BLOCK_LINES)
    end = index_of(following, lambda s: has(s, P.CARE_STOP))
    kept = F.filter(F.slice(following, F.lit(1), F.coalesce(end, F.size(following))),
                    lambda s: ~has(s, P.BARE_FRAGMENT))
    return F.when(start.isNotNull(), F.array_join(F.concat(F.array(F.get(lines, start)), kept), "\n"))


def care_block(docs: DataFrame) -> DataFrame:
    return emit_one(docs, care_start(line_col()), lambda k: F.struct(
        k.alias("start_line"), care_block_value(line_col(), k).alias("block")))


def _noise(s: Column) -> Column:
    return any_of([F.length(s) <= 3, has(s, P.BARE_FRAGMENT), has(s, P.BARE_NUMBER), has(s, P.DECLARATION_HEADING)])


_FOLD_START = "struct(cast(array() as array<string>) as kept, false as done)"


def continuation_value(lines: Column, start: Column, ahead: int = P.NEARBY_LINES, cap: int = P.ENTITY_LINES) -> Column:
    """Text after a heading: leading noise is skipped, later noise ends it, a trailing comma extends it."""
    def step(state: Column, s: Column) -> Column:
        grown = F.concat(state["kept"], F.array(s))
        ends = (F.size(grown) >= cap) | ~s.endswith(",")
        return (F.when(state["done"], state)
                .when(_noise(s), F.struct(state["kept"].alias("kept"), (F.size(state["kept"]) > 0).alias("done")))
                .otherwise(F.struct(grown.alias("kept"), ends.alias("done"))))
    folded = F.aggregate(window_after(lines, start, ahead), F.expr(_FOLD_START), step)
    return F.when(start.isNotNull(), F.array_join(folded["kept"], " "))


def continuation(docs: DataFrame, heading: str = P.HEADING_ONLY) -> DataFrame:
    return emit_one(docs, index_of(line_col(), lambda s: has(s, heading)), lambda k: F.struct(
        k.alias("start_line"), continuation_value(line_col(), k).alias("value")))


def _has_area(box: Column) -> Column:
    return box.isNotNull() & (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])


def _sorted_column_below(detections: Column, head: Column, tolerance: Column, slack: int, reach: int,
                         from_edge: str) -> Column:
    below = F.filter(detections, lambda d: all_of([
        d["x2"] > d["x1"], d["y2"] > d["y1"], d["y1"] >= head[from_edge] - slack,
        d["y1"] <= head["y2"] + reach, F.abs(d["x1"] - head["x1"]) <= tolerance]))
    return F.array_sort(F.transform(below, lambda d: F.struct(
        d["y1"].alias("y1"), d["x1"].alias("x1"), d["pos"].alias("pos"), d["y2"].alias("y2"),
        strip(d["text"]).alias("text"))))


def spatial_continuation_value(detections: Column, heading_text: Column) -> Column:
    """Continuation by layout: same column, below the heading, no large gap. NULL without a usable heading box."""
    def state_of(kept: Column, bottom: Column, done: Column) -> Column:
        return F.struct(kept.alias("kept"), bottom.cast("double").alias("bottom"), done.alias("done"))

    def step(state: Column, d: Column) -> Column:
        text, any_kept = d["text"], F.size(state["kept"]) > 0
        gap = (d["y1"] - state["bottom"]) > F.greatest(F.lit(50.0), (d["y2"] - d["y1"]) * 2.5)
        other = any_of([has(text, P.DECLARATION_HEADING), has(text, P.ANY_ROLE_HEADING), has(text, P.BARE_FRAGMENT),
                        has(text, P.BARE_NUMBER)])
        grown = F.concat(state["kept"], F.array(text))
        ends = has(text, P.ADDRESS_ELSEWHERE) | (F.size(grown) >= P.SPATIAL_ENTITY_LINES)
        return (F.when(state["done"], state)
                .when(gap, state_of(state["kept"], state["bottom"], F.lit(True)))
                .when(F.length(text) == 0, state)
                .when(other, state_of(state["kept"], state["bottom"], any_kept))
                .otherwise(state_of(grown, d["y2"], ends)))

    def under(head: Column) -> Column:
        tolerance = F.greatest(F.lit(50.0), (head["x2"] - head["x1"]) * 0.5)
        column = F.filter(_sorted_column_below(detections, head, tolerance, 3, 360, "y2"), lambda d: d["pos"] != head["pos"])
        start = state_of(F.expr("cast(array() as array<string>)"), head["y2"], F.lit(False))
        return F.when(_has_area(head), F.array_join(F.aggregate(column, start, step)["kept"], " "))

    return let(first_where(detections, lambda d: strip(d["text"]) == heading_text), under)


def spatial_continuation(docs: DataFrame, heading: str = P.HEADING_ONLY) -> DataFrame:
    return emit_one(docs, first_where(line_col(), lambda s: has(s, heading)), lambda h: F.struct(
        h.alias("heading"), spatial_continuation_value(box_col(), h).alias("value")))


# ---- entities -----------------------------------------------------------------------------------

def is_heading_only(value: Column) -> Column:
    """A joined value counts as heading-only when every segment is a bare heading."""
    segments = F.filter(F.split(value, r" \| "), lambda s: F.length(strip(s)) > 0)
    return (F.size(segments) > 0) & F.forall(segments, lambda s: has(strip(s), P.HEADING_ONLY))


def role_array(docs: DataFrame, use_layout: bool = False) -> DataFrame:
    """Adds ``roles``: one struct per declared role, in text order. A line serves one role only."""
    # Every heading holds a linking word, which is cheap to look for; other lines become NULL and never match.
    linked = F.transform(line_col(), lambda s: let(F.lower(s), lambda w: F.when(
        w.contains("by") | w.contains("8y") | w.contains("for"), s)))
    staged = docs.withColumn("_claimed", F.expr("cast(array() as array<int>)")).withColumn("_linked", linked)
    for role, pattern in P.ROLE_HEADINGS.items():
        def matches(s: Column, i: Column, heading: str = pattern) -> Column:
            return F.when(has(s, heading) & ~F.array_contains(F.col("_claimed"), i), i)
        hits = F.array_compact(F.transform(F.col("_linked"), lambda s, i: matches(s, i)))
        staged = staged.withColumn(f"_{role}", F.get(hits, F.lit(0)))
        staged = staged.withColumn("_claimed", F.when(F.col(f"_{role}").isNotNull(), F.concat(
            F.col("_claimed"), F.array(F.col(f"_{role}")))).otherwise(F.col("_claimed")))
    found = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"_{role}").isNotNull(), F.struct(F.col(f"_{role}").alias("n"), F.lit(role).alias("role")))
        for role in P.ROLE_HEADINGS])))
    staged = staged.withColumn("_found", found)

    def resolve(r: Column) -> Column:
        heading = F.get(line_col(), r["n"])
        by_lines = continuation_value(line_col(), r["n"])
        more = F.coalesce(spatial_continuation_value(box_col(), heading), by_lines) if use_layout else by_lines
        value = F.when(has(heading, P.HEADING_ONLY), strip(F.concat_ws(" ", heading, more))).otherwise(heading)
        return F.struct(r["n"].alias("n"), r["role"].alias("role"), value.alias("value"))

    keep = [c for c in docs.columns]
    return staged.withColumn("roles", F.transform("_found", resolve)).select(*keep, "roles")


def role_declarations(docs: DataFrame, use_layout: bool = False) -> DataFrame:
    return emit(role_array(docs, use_layout), F.col("roles"))


def heading_only(docs: DataFrame) -> DataFrame:
    """Which role values are still only a heading."""
    return role_declarations(docs).select("doc_id", "n", "role", is_heading_only(F.col("value")).alias("heading_only"))


# ---- consumer care ------------------------------------------------------------------------------

def paired_heading_value(lines: Column, first: str = P.CARE_SPLIT_FIRST, second: str = P.CARE_SPLIT_SECOND,
                         window: int = P.CARE_SPLIT_LINES) -> Column:
    """A heading split over two nearby lines: struct of both indexes, NULL when there is none."""
    def pair(s: Column, i: Column) -> Column:
        other = index_near(lines, i, lambda t: has(t, second), window)
        return F.when(has(s, first) & other.isNotNull(), F.struct(i.alias("first_line"), other.alias("second_line")))
    return F.get(F.array_compact(F.transform(lines, pair)), F.lit(0))


def paired_heading(docs: DataFrame, first: str = P.CARE_SPLIT_FIRST, second: str = P.CARE_SPLIT_SECOND,
                   window: int = P.CARE_SPLIT_LINES) -> DataFrame:
    return emit(docs, F.array(paired_heading_value(line_col(), first, second, window)))


def contact_in(texts: Column) -> Column:
    """First phone-shaped and first e-mail token over an ordered array of texts."""
    return F.struct(F.get(F.array_compact(F.transform(texts, M.phone)), F.lit(0)).alias("telephone_number"),
                    F.get(F.array_compact(F.transform(texts, M.email)), F.lit(0)).alias("email_address"))


def line_contacts_value(lines: Column, start: Column, window: int = P.CARE_CONTACT_LINES) -> Column:
    return contact_in(F.slice(lines, start + 1, F.lit(window)))


def spatial_contacts_value(detections: Column, trigger_text: Column) -> Column:
    """Contacts in the column below the trigger, up to the next heading. NULL without a usable trigger box."""
    def under(head: Column) -> Column:
        tolerance = F.greatest(F.lit(80.0), (head["x2"] - head["x1"]) * 0.35)
        column = _sorted_column_below(detections, head, tolerance, 5, 450, "y1")
        stop = index_of(column, lambda d: (d["text"] != trigger_text) & has(d["text"], P.DECLARATION_HEADING)
                        & ~has(d["text"], r"\b(?:write|send)\b.*\bmfg\.?\s+address\b"))
        before = F.slice(column, F.lit(1), F.coalesce(stop, F.size(column)))
        return F.when(_has_area(head), contact_in(F.transform(before, lambda d: d["text"])))

    return let(first_where(detections, lambda d: strip(d["text"]) == trigger_text), under)


def contacts(docs: DataFrame, use_layout: bool = False, window: int = P.CARE_CONTACT_LINES) -> DataFrame:
    def found(k: Column) -> Column:
        by_lines = line_contacts_value(line_col(), k, window)
        both = F.coalesce(spatial_contacts_value(box_col(), F.get(line_col(), k)), by_lines) if use_layout else by_lines
        return let(both, lambda c: F.struct(k.alias("start_line"), c["telephone_number"].alias("telephone_number"),
                                            c["email_address"].alias("email_address")))
    return emit_one(docs, care_start(line_col()), found)


def care_name(line: Column) -> Column:
    return F.initcap(F.lower(F.regexp_replace(group(line, P.CARE_NAME, 0), r"\s+", " ")))


def care_address(block: Column, name: Column) -> Column:
    """The block without its lead-in, phone, e-mail and bare contact labels; NULL when nothing is left."""
    trimmed = lambda c: F.regexp_replace(c, r"^[ :\-\n]+|[ :\-\n]+$", "")
    without_name = F.when(name.isNotNull() & F.lower(block).startswith(F.lower(name)),
                          F.substring(block, F.length(name) + 1, F.length(block))).otherwise(block)
    led = F.regexp_replace(without_name, P.java(P.CARE_LEAD_IN), "")
    no_contact = F.regexp_replace(F.regexp_replace(trimmed(led), P.java(P.PHONE), ""), P.java(P.EMAIL), "")
    no_label = F.regexp_replace(no_contact, r"(?iUm)^\s*(?:(?:or\s+)?call|phone|mobile|telephone|e?-?mail)\s*[:\-]?\s*$\n?", "")
    no_or = F.regexp_replace(no_label, r"(?iUm)^\s*or\s*$\n?", "")
    return F.nullif(trimmed(no_or), F.lit(""))


def contact_name(docs: DataFrame) -> DataFrame:
    """Name of the office and the address text of the care block."""
    def named(k: Column) -> Column:
        return let(care_name(F.get(line_col(), k)), lambda name: F.struct(
            name.alias("name"), care_address(care_block_value(line_col(), k), name).alias("address")))
    return emit_one(docs, care_start(line_col()), named)


# ---- typed values -------------------------------------------------------------------------------

def line_amounts(docs: DataFrame) -> DataFrame:
    rows = F.flatten(F.transform(line_col(), lambda s, i: F.transform(M.amounts(s), lambda a, o: F.struct(
        i.alias("n"), o.alias("ord"), a.alias("amount")))))
    return emit(docs, rows)


def _parsed_rows(docs: DataFrame, parse: dict, required: str) -> DataFrame:
    rows = F.transform(line_col(), lambda s, i: F.struct(i.alias("n"), *[fn(s).alias(k) for k, fn in parse.items()]))
    return emit(docs, F.filter(rows, lambda r: r[required].isNotNull()))


def line_quantities(docs: DataFrame) -> DataFrame:
    return _parsed_rows(docs, {"amount": M.quantity_amount, "basis": M.quantity_basis}, "amount")


def line_package_counts(docs: DataFrame) -> DataFrame:
    return _parsed_rows(docs, {"packages": M.package_count}, "packages")


def line_unit_prices(docs: DataFrame) -> DataFrame:
    return _parsed_rows(docs, {"amount": M.unit_price_amount, "unit": M.unit_price_unit}, "amount")


def line_months(docs: DataFrame) -> DataFrame:
    return _parsed_rows(docs, {"year_month": M.year_month}, "year_month")


def coverage(docs: DataFrame, parse, by: Column, shape: str) -> DataFrame:
    """Parsed / unparsed counts by group over lines that carry the given shape."""
    shaped = F.filter(line_col(), lambda s: has(s, shape))
    per_doc = docs.select(by.alias("grp"), F.size(shaped).alias("shaped"),
                          F.size(F.filter(shaped, lambda s: parse(s).isNotNull())).alias("parsed"))
    return per_doc.groupBy("grp").agg(F.sum("shaped").alias("shaped"), F.sum("parsed").alias("parsed"),
                                      F.sum(F.col("shaped") - F.col("parsed")).alias("unparsed"))


def future_date_check(docs: DataFrame, reference_year: int, reference_month: int) -> DataFrame:
    """A manufacture month after the reference month is sent to review, never failed."""
    dated = emit_one(docs, date_near_index(line_col()), lambda n: F.struct(
        M.year_month(F.get(line_col(), n)).alias("year_month")))
    future = F.col("year_month") > reference_year * 100 + reference_month
    return dated.select("doc_id", "year_month",
                        F.when(future, "NEEDS_MANUAL_VERIFICATION").otherwise("PASS").alias("status"))


def country_text(lines: Column) -> Column:
    """Keyword line, completed from a nearby single word, in canonical form; NULL without a keyword."""
    def complete(k: Column) -> Column:
        line = F.get(lines, k)
        nearby = index_near(lines, k, lambda s: has(s, P.COUNTRY_WORD) & ~has(s, P.NUTRITION_ROW),
                            excluded=neighbour_flags(lines, P.NUTRITION_ROW))
        joined = F.when(M.country_remainder(line).isNull(), F.concat_ws(" ", line, F.get(lines, nearby))).otherwise(line)
        return F.when(k.isNotNull(), let(joined, M.canonical_country))
    return let(keyword_index("country_of_origin"), complete)


def country(docs: DataFrame) -> DataFrame:
    return emit_one(docs, country_text(line_col()), lambda c: F.struct(c.alias("country")))


def spatial_pair_value(detections: Column, marker: str = P.MADE_IN_MARKER) -> Column:
    """Nearest single word under a marker box with enough horizontal overlap."""
    def best(m: Column) -> Column:
        height = m["y2"] - m["y1"]
        overlap = lambda d: F.greatest(F.lit(0), F.least(m["x2"], d["x2"]) - F.greatest(m["x1"], d["x1"]))
        narrower = lambda d: F.least(m["x2"] - m["x1"], d["x2"] - d["x1"])
        near = F.filter(detections, lambda d: all_of([
            d["pos"] != m["pos"], has(strip(d["text"]), P.COUNTRY_WORD), ~has(d["text"], P.NUTRITION_ROW),
            d["x2"] > d["x1"], d["y2"] > d["y1"], d["y1"] >= m["y1"],
            d["y1"] <= m["y2"] + F.greatest(F.lit(80), height * 4), overlap(d) >= narrower(d) * 0.35]))
        pick = F.array_min(F.transform(near, lambda d: F.struct(
            (d["y1"] - m["y2"]).alias("dy"), d["pos"].alias("pos"), strip(d["text"]).alias("text"),
            d["confidence"].alias("confidence"))))
        return F.when(has(strip(m["text"]), marker) & (m["x2"] > m["x1"]) & (height > 0) & pick.isNotNull(), F.struct(
            F.concat(F.lit("MADE IN "), F.upper(pick["text"])).alias("value"),
            F.round((m["confidence"] + pick["confidence"]) / 2, 4).alias("confidence"),
            m["pos"].alias("marker_pos"), pick["pos"].alias("value_pos")))
    return F.get(F.array_compact(F.transform(detections, best)), F.lit(0))


def spatial_pair(docs: DataFrame, marker: str = P.MADE_IN_MARKER) -> DataFrame:
    return emit(docs, F.array(spatial_pair_value(box_col(), marker)))


# ---- identity -----------------------------------------------------------------------------------

def _descriptive(s: Column) -> Column:
    return all_of([has(s, P.COMMODITY_NOUN), ~s.contains(","), F.length(s) <= 40, ~has(s, P.SERVING_SIZE),
                   ~has(s, P.BUSINESS_ENTITY)])


def identity_index(lines: Column) -> Column:
    """A short line naming a commodity; several words are preferred over one."""
    def best(near_food: Column) -> Column:
        def score(s: Column, i: Column) -> Column:
            ok = all_of([_descriptive(s), ~has(s, P.DECLARATION_HEADING), ~has(s, P.BARE_NUMBER),
                         ~has(s, P.NUTRITION_ROW), ~F.get(near_food, i)])
            words = F.size(F.filter(tokens(s), lambda w: ~w.isin("a", "b", "c")))
            return F.when(ok, F.struct(F.when(words > 1, 0).otherwise(1).alias("rank"), i.alias("n")))
        return F.array_min(F.transform(lines, score))["n"]

    return let(neighbour_flags(lines, P.NUTRITION_ROW), best)


def identity_candidate(docs: DataFrame) -> DataFrame:
    return emit_one(docs, identity_index(line_col()), _numbered_line)


def component_array(lines: Column, detections: Column) -> Column:
    """Enumerated items, each with the quantity line of least layout cost; greedy one-to-one.

    The arrays hold one label, so the pairs scored here are items times quantity lines of that label.
    """
    item_rows = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("n"), s.alias("text"))),
                         lambda r: has(r["text"], P.ENUMERATED_ITEM) & _descriptive(group(r["text"], P.ENUMERATED_ITEM, 2)))
    quantity_rows = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("n"), s.alias("text"))),
                             lambda r: has(r["text"], P.COMPONENT_QUANTITY))

    def boxed(rows: Column) -> Column:
        return F.transform(rows, lambda r: F.struct(r["n"].alias("n"), r["text"].alias("text"),
                                                    first_where(detections, lambda d: d["text"] == r["text"]).alias("box")))
    def pair_up(items: Column, quantities: Column) -> Column:
        def costs_of(p: Column, pi: Column) -> Column:
            def cost(q: Column, qi: Column) -> Column:
                dx = F.abs((p["box"]["x1"] + p["box"]["x2"]) / 2 - (q["box"]["x1"] + q["box"]["x2"]) / 2)
                dy = q["box"]["y1"] - p["box"]["y1"]
                return F.when(dy.between(0, 250), F.struct((dx + dy * 0.1).alias("cost"), pi.alias("p"), qi.alias("q")))
            return F.array_compact(F.transform(quantities, cost))

        empty = F.expr("cast(array() as array<struct<cost:double,p:int,q:int>>)")
        greedy = F.aggregate(F.array_sort(F.flatten(F.transform(items, costs_of))), empty, lambda acc, c: F.when(
            F.exists(acc, lambda t: (t["p"] == c["p"]) | (t["q"] == c["q"])), acc).otherwise(F.concat(acc, F.array(c))))

        def assigned(chosen: Column) -> Column:
            def assign(p: Column, pi: Column) -> Column:
                index = (F.when(F.size(chosen) > 0, first_where(chosen, lambda t: t["p"] == pi)["q"])
                         .when(pi < F.size(quantities), pi))
                return F.struct(p["n"].alias("n"), p["text"].alias("name"), F.get(quantities, index)["text"].alias("quantity"))
            return F.transform(items, assign)

        return F.when(F.size(items) >= 2, let(greedy, assigned))

    return let(boxed(item_rows), lambda items: let(boxed(quantity_rows), lambda quantities: pair_up(items, quantities)))


def enumerated_components(docs: DataFrame) -> DataFrame:
    return emit(docs, component_array(line_col(), box_col()))


# ---- other identifiers on the label -----------------------------------------------------------------

def licence_numbers(docs: DataFrame) -> DataFrame:
    return emit_one(docs, group(F.array_join(line_col(), "\n"), P.LICENCE), lambda v: F.struct(v.alias("value")))


def barcode_lines(docs: DataFrame) -> DataFrame:
    return emit_one(docs, first_where(line_col(), lambda s: has(s, P.BARCODE_LINE)), lambda v: F.struct(v.alias("value")))


def batch_numbers(docs: DataFrame) -> DataFrame:
    """A batch code stands on a line of its own and holds a digit."""
    return value_near(docs, P.BATCH_KEYWORD, P.BATCH_VALUE).where(has(F.col("value"), "[0-9]"))


def expiry_dates(docs: DataFrame) -> DataFrame:
    return value_near(docs, P.EXPIRY_KEYWORD, P.EXPIRY_VALUE)


def warning_lines(docs: DataFrame) -> DataFrame:
    kept = F.array_distinct(F.filter(line_col(), lambda s: has(s, P.WARNING)))
    return emit(docs, F.transform(kept, lambda w, i: F.struct(i.alias("ord"), w.alias("warning"))))
