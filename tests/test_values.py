"""Known values of identifiers, quantities, comparisons, calculations and roll-ups."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from labelwright.functions import identifiers, measures
from labelwright.functions.text import padded_tokens
from labelwright.operators import evidence, geometry, integrity, joins, lines, listing, lots, metrics, rollup, rules
from labelwright.plans import reference_tables
from labelwright.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize("code", ["96385074", "036000291452", "4006381333931", "10012345678902"])
def test_valid_gtins(spark, code):
    assert one(spark, identifiers.classify_gtin(F.lit(code), F.lit(None).cast("string"))["status"]) == "VALID_GTIN"


@pytest.mark.parametrize("code,symbol,status", [
    ("8901234567890X", None, "MALFORMED_IDENTIFIER"), ("４００６３８１３３３９３１", None, "MALFORMED_IDENTIFIER"), ("", None, "INVALID_GTIN"),
    ("4006381333932", None, "INVALID_GTIN"), ("4006381333931", "QR", "UNSUPPORTED_IDENTIFIER"), ("12345", None, "UNSUPPORTED_IDENTIFIER"),
    ("4006381333931", "UPC-A", "INVALID_GTIN"), ("4006 3813-33931", "ean13", "VALID_GTIN")])
def test_gtin_classes(spark, code, symbol, status):
    assert one(spark, identifiers.classify_gtin(F.lit(code), F.lit(symbol).cast("string"))["status"]) == status


def test_zero_suppressed_code(spark):
    assert one(spark, identifiers.expand_upc_e(F.lit("04252614"))) == "042100005264"


@pytest.mark.parametrize("value,kind,status", [
    ("11422010000018", "fssai", "valid"), ("11422010000017", "fssai", "invalid"), ("1234567890123", "fssai", "ambiguous"), ("8901234567891", "ean13", "valid"), ("8901234567892", "ean13", "invalid"),
    ("123456789012", "ean13", "ambiguous"), ("R-12345678", "bis_registration", "valid"), ("R-1234567", "bis_registration", "invalid"),
    ("r-123", "bis_registration", "ambiguous"), ("hello", "unknown", "ambiguous"), (None, "unknown", "invalid")])
def test_anchor_classes(spark, value, kind, status):
    got = one(spark, identifiers.classify_anchor(F.lit(value).cast("string")))
    assert (got.anchor_type, got.status) == (kind, status)


@pytest.mark.parametrize("text,amount,basis", [
    ("Net Weight: 75 g", 75.0, "weight"), ("1 kg", 1000.0, "weight"), ("500 ml", 500.0, "volume"), ("0.5 L", 500.0, "volume"), ("a lot", None, None)])
def test_quantities(spark, text, amount, basis):
    row = spark.range(1).select(measures.quantity_amount(F.lit(text)).alias("a"), measures.quantity_basis(F.lit(text)).alias("b")).head()
    assert (row.a, row.b) == (amount, basis)


@pytest.mark.parametrize("text,expected", [
    ("12/05/2024", 202405), ("05/2024", 202405), ("01/26", 202601), ("Mar 2025", 202503), ("December 24", 202412), ("13/2024", None), ("none", None)])
def test_months(spark, text, expected):
    assert one(spark, measures.year_month(F.lit(text))) == expected


@pytest.mark.parametrize("text,expected", [
    ("MRP ₹ 20.00", ["20.00"]), ("M.R.P.: 45", ["45"]), ("Rs. 10 or INR 12", ["10", "12"]), ("24 hours", [])])
def test_amounts(spark, text, expected):
    assert one(spark, measures.amounts(F.lit(text))) == expected


@pytest.mark.parametrize("text,ok", [("1800-123-4567", True), ("10012021000039", False), ("022-6691 6929", True), ("9811022033", True)])
def test_phone_shapes(spark, text, ok):
    assert (one(spark, measures.phone(F.lit(text))) is not None) == ok


@pytest.mark.parametrize("a,b,outcome", [
    ("500 g", "0.5 kg", "MATCH"), ("500 g", "1 kg", "MISMATCH"), ("500 g", "500 ml", "REVIEW_REQUIRED"), ("500 g", "a lot", "REVIEW_REQUIRED")])
def test_compare_quantity(spark, a, b, outcome):
    assert one(spark, joins.compare_quantity(F.lit(a), F.lit(b))) == outcome


def test_compare_others(spark):
    assert one(spark, joins.compare_country(F.lit("Made in  India."), F.lit("Country of Origin: INDIA"))) == "MATCH"
    assert one(spark, joins.compare_price(F.lit("1,200.00"), F.lit("Rs 1200"))) == "MATCH"
    assert one(spark, joins.compare_maker(F.lit("Acme Foods"), F.lit("Other"))) == "REVIEW_REQUIRED"


@pytest.mark.parametrize("declared,mpe", [(75.0, 4.5), (50.0, 4.5), (250.0, 9.0), (999.0, 15.0), (1500.0, 23.0), (20000.0, 200.0), (0.0, None)])
def test_permissible_error(spark, declared, mpe):
    df = spark.createDataFrame([(declared,)], "declared double")
    assert lots.max_permissible_error(df, reference_tables.table(spark, "permissible_error")).head().mpe == mpe


def test_deficiency_and_area(spark):
    row = lots.package_deficiency(spark.createDataFrame([(75.0, 69.0, 4.5)], "declared double, actual double, mpe double")).head()
    assert (row.error, row.exceeds_mpe, row.exceeds_twice_mpe) == (6.0, True, False)
    cols = "doc_id int, area_cm2 double, shape string, height_cm double, height_mm double, width_cm double, width_mm double, circumference_cm double, circumference_mm double, considered_cm2 double, surface_cm2 double"
    packages = spark.createDataFrame([(1, None, "rectangular", 10.0, None, None, 50.0, None, None, None, None)], cols)
    assert lots.panel_area(packages, {"rectangular": 1.0, "cylindrical": 0.4, "other": 0.4}).head().panel_area_cm2 == 50.0


def test_lot_of_one_hundred_passes(spark):
    lot = spark.createDataFrame([(1, 100, 75.0)], "lot_id int, lot_size int, declared double")
    samples = spark.range(50).select(F.lit(1).alias("lot_id"), F.lit(75.0).alias("quantity"), F.lit(True).alias("declarations_present"))
    tables = [reference_tables.table(spark, n) for n in ("sampling_plan", "permissible_error")]
    assert lots.lot_approval(lot, samples, *tables).head().status == "PASS"
    assert lots.lot_approval(lot, samples.limit(49), *tables).head().status == "NOT_ASSESSED"


@pytest.mark.parametrize("statuses,status,score", [
    (["PASS"] * 5 + ["NEEDS_MANUAL_VERIFICATION"] * 3, "REVIEW_REQUIRED", 100.0), (["NEEDS_MANUAL_VERIFICATION"] * 8, "REVIEW_REQUIRED", None),
    (["PASS", "FAIL", "NEEDS_MANUAL_VERIFICATION"], "NON_COMPLIANT", 50.0), (["NOT_APPLICABLE"], "NOT_APPLICABLE", None), (["PASS", "PARTIAL"], "NON_COMPLIANT", 50.0),
    (["PASS"], "COMPLIANT", 100.0)])
def test_rollup(spark, statuses, status, score):
    df = spark.createDataFrame([(1, s) for s in statuses], "doc_id int, status string")
    row = rollup.rollup_checks(df, ["doc_id"]).head()
    assert (row.status, row.score) == (status, score)


KINDS = {"num": "v_num", "str": "v_str", "bool": "v_bool", "arr": "v_arr"}


def truth(spark, fact, op, value):
    """``fact``: None for absent, ('null',) for a known null, else (kind, value)."""
    f = F.struct(F.lit(fact is not None).alias("known"), *[
        F.lit(fact[1] if fact and KINDS.get(fact[0]) == c else None).cast(t).alias(c)
        if not (fact and KINDS.get(fact[0]) == c == "v_arr") else F.array(*[F.lit(x) for x in fact[1]]).alias(c)
        for c, t in (("v_num", "double"), ("v_str", "string"), ("v_bool", "boolean"), ("v_arr", "array<string>"))])
    return one(spark, rules.truth_name(rules.apply_operator(f, op, value)))


@pytest.mark.parametrize("fact,op,value,result", [
    (None, "exists", None, "UNKNOWN"), (("null",), "exists", None, "FALSE"), (("null",), "not_exists", None, "TRUE"), (("num", 1.0), "exists", None, "TRUE"),
    (("num", 1.0), "eq", 1, "TRUE"), (("bool", True), "eq", 1, "FALSE"), (("str", "a"), "eq", ["a", "b"], "TRUE"), (("null",), "eq", "a", "FALSE"), (("null",), "ne", "a", "TRUE"),
    (None, "ne", "a", "UNKNOWN"), (("num", 2.0), "gt", 1, "TRUE"), (("bool", True), "gt", 0, "UNKNOWN"), (("str", "2"), "lte", 3, "UNKNOWN"), (("num", float("nan")), "lt", 3, "UNKNOWN"),
    (("null",), "not_in", ["a"], "TRUE"), (("str", "a"), "in", "a", "UNKNOWN"), (("str", "abc"), "matches", "b", "TRUE"), (("num", 1.0), "matches", "1", "UNKNOWN"),
    (("str", "Hello"), "contains", "ELL", "TRUE"), (("arr", ["x", "y"]), "contains", "y", "TRUE"), (("num", 1.0), "contains", "1", "FALSE"),
    (("str", "Hello"), "contains_any", ["zz", "LL"], "TRUE"), (("null",), "contains_any", ["a"], "FALSE"), (("null",), "not_contains_any", ["a"], "TRUE"),
    (("num", 5.0), "between", [5, 6], "TRUE"), (("str", "5"), "between", [5, 6], "UNKNOWN"), (None, "between", [1, 2], "UNKNOWN")])
def test_truth_table(spark, fact, op, value, result):
    assert truth(spark, fact, op, value) == result


def merkle(values):
    """Brute force: leaves as ASCII text, upper levels as raw digests, an odd last node twice."""
    level = [v.encode() for v in values]
    while len(level) > 1:
        if len(level) % 2:
            level.append(level[-1])
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 16, 17, 23, 63, 64, 65])
def test_merkle_blocks_equal_plain_fold(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame([("g", i, v) for i, v in reversed(list(enumerate(leaves)))], "g string, i bigint, leaf string")
    assert integrity.merkle_root(df, "g", "i", "leaf", block_bits=2, rounds=4).head().merkle_root == merkle(leaves)


def test_percentile_and_median(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 2, 3, 3]], "v double").withColumn("k", F.lit(1))
    ordered = sorted([5, 1, 4, 2, 3, 3])
    for p in (0, 10, 50, 95, 100):
        assert metrics.nearest_rank_percentile(df, ["k"], "v", p).head().value == ordered[round(p / 100 * 5)]
    assert metrics.median(df, ["k"], "v").head().value == 3.0


def docs(spark, *labels):
    """Documents from lists of lines, one box per line in a column."""
    rows = [(i, ls, [(n, s, 0.9, 40, 30 * n, 40 + 8 * len(s), 30 * n + 22) for n, s in enumerate(ls)]) for i, ls in enumerate(labels)]
    return spark.createDataFrame(rows, "doc_id int, lines array<string>, detections array<struct<pos:int,text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>")


GOOD = ["Potato Chips", "Net Quantity: 1 kg", "MRP Rs. 20.00 (Inclusive of all taxes)", "Manufactured by:", "PARLE BISCUITS PVT. LTD.,", "Mumbai 400057",
        "Country of Origin: India", "Mfg 05/2024", "Consumer Care Cell, Tower Road", "care@example.com 1800-123-4567"]


def fields(spark, lines_):
    return {r.field: r for r in evidence.extract_fields(docs(spark, lines_)).collect()}


def test_fields_of_a_good_label(spark):
    f = fields(spark, GOOD)
    assert f["maximum_retail_price_mrp"].value == GOOD[2]
    assert f["manufacturer_packer_importer_details"].value == "Manufactured by: PARLE BISCUITS PVT. LTD., Mumbai 400057"
    assert f["common_generic_name_of_commodity"].value == "Potato Chips"
    assert abs(f["common_generic_name_of_commodity"].confidence - 0.9 * 0.75) < 1e-9
    care = f["consumer_care_details"]
    assert (care.care_name, care.care_email_address, care.care_telephone_number) == ("Consumer Care Cell", "care@example.com", "1800-123-4567")
    assert f["net_quantity"].region_ids == ["region_1"]


def test_structured_view_is_made_in_one_pass(spark):
    """The leaves of fields, roles, warnings, barcode and licence leave a document together; a detected field of no reading stays without a value."""
    label = GOOD + ["WARNING: keep out of reach", "4006381333931", "FSSAI Lic. No. 11422010000018", "Imported by:"]
    view = evidence.structured_extraction(docs(spark, label, ["nothing here"]))
    assert view.columns == ["doc_id", "path", "value", "raw_text", "ocr_confidence", "extraction_confidence"]
    assert view._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    table = {r.field: r for r in evidence.extract_fields(docs(spark, label)).collect()}
    rows = view.collect()
    got = {r.path: r for r in rows}
    assert len(got) == len(rows) and {r.doc_id for r in rows} == {min(r.doc_id for r in rows)}
    for field, path in (("maximum_retail_price_mrp", "pricing.maximum_retail_price_mrp"), ("net_quantity", "quantity"), ("country_of_origin", "origin.country_of_origin")):
        assert (got[path].raw_text, got[path].ocr_confidence) == (table[field].raw_text, table[field].confidence)
    assert got["origin.country_of_origin"].value == table["country_of_origin"].value
    assert (got["warnings"].value, got["warnings"].extraction_confidence) == ("WARNING: keep out of reach", 0.8)
    assert (got["identification.barcode"].value, got["food_information.licence"].value) == ("4006381333931", "11422010000018")
    assert (got["business_details.importer"].value, got["business_details.importer"].extraction_confidence) == (None, 0.0)


def test_tokens_are_padded(spark):
    texts = [("  A-b  c1 ", " a b c1 "), ("", "  "), ("--", "  "), ("É x\ty", " x y "), (None, None)]
    frame = spark.createDataFrame(texts, "t string, want string")
    assert [r.got for r in frame.select(padded_tokens(F.col("t")).alias("got")).collect()] == [w for _, w in texts]


def test_unit_price_proviso_and_missing_care(spark):
    table = evidence.extract_fields(docs(spark, GOOD, GOOD[:8]))
    checks = {(r.doc_id, r.field): r.status for r in rollup.field_checks(table, 2026, 6).collect()}
    assert checks[0, "unit_sale_price"] == "PASS"  # exactly one kilogram needs no unit price
    assert checks[0, "consumer_care_details"] == "PASS"
    assert checks[1, "consumer_care_details"] == "NEEDS_MANUAL_VERIFICATION"  # not detected is not absent


def test_price_on_three_lines(spark):
    f = fields(spark, ["MRP.", "BATCH No.", "(INCL. OF ALL TAXES)", "20.00"])
    assert f["maximum_retail_price_mrp"].value == "MRP. 20.00 (INCL. OF ALL TAXES)"
    f = fields(spark, ["MRP.", "x y", "Rs. 20.00", "(INCL. OF ALL TAXES)"])
    assert f["maximum_retail_price_mrp"].value == "MRP. Rs. 20.00 (INCL. OF ALL TAXES)"


def test_nutrition_lines_are_no_quantity(spark):
    f = fields(spark, ["NET WEIGHT:", "Protein", "6.6 g", "50 g"])
    assert f["net_quantity"].value == "NET WEIGHT: 50 g"


@pytest.mark.parametrize("line", ["Best used within 24 hours.", "Homemade Ingredients", "Cabinet Weight Capacity", "Original Gluco", "Special Price Period"])
def test_no_field_inside_other_words(spark, line):
    found = [r.field for r in lines.match_keywords(docs(spark, [line])).collect()]
    assert found == []


def test_continuation_skips_noise_then_stops(spark):
    d = docs(spark, ["MANUFACTURED FOR", "NUTRITION INFORMATION", "INGREDIENTS:", "PARLE BISCUITS PVT. LTD.,", "North Level Crossing,", "Mumbai 400057", "Net Wt 5 g"])
    assert lines.continuation(d).head().value == "PARLE BISCUITS PVT. LTD., North Level Crossing, Mumbai 400057"


def test_roles_claim_a_line_once(spark):
    d = docs(spark, ["MANUFACTURED & MARKETED BY: Acme", "Packed by Beta Ltd"])
    assert [(r.role, r.value) for r in lines.role_declarations(d).orderBy("n").collect()] == [
        ("manufacturer", "MANUFACTURED & MARKETED BY: Acme"), ("packer", "Packed by Beta Ltd")]


def test_components_pair_with_quantities(spark):
    d = docs(spark, ["A. Choco Wafers", "(2 units x 12.5 g)", "B. Butter Cookies", "(3 units x 10 g)"])
    got = {r.name: r.quantity for r in lines.enumerated_components(d).collect()}
    assert got == {"A. Choco Wafers": "(2 units x 12.5 g)", "B. Butter Cookies": "(3 units x 10 g)"}


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, t, c, *b) for i, (t, c, b) in enumerate(rows)], "image_id int, pos int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")


def test_box_matching_uses_each_box_once(spark):
    a = boxes(spark, [("MRP 199", 0.9, (10, 10, 110, 40)), ("Net 5 g", 0.8, (10, 60, 110, 90)), ("lonely", 0.7, (400, 400, 450, 420))])
    b = boxes(spark, [("MRP 299", 0.8, (12, 11, 111, 41)), ("net  5 G", 0.9, (11, 61, 112, 91)), ("dup", 0.5, (13, 12, 100, 39))])
    out = joins.match_boxes(a, b).collect()
    assert sorted(r.status for r in out) == ["consensus", "disagreement", "other_only", "single_source"]
    left = [r.left_pos for r in out if r.left_pos is not None]
    right = [r.right_pos for r in out if r.right_pos is not None]
    assert sorted(left) == [0, 1, 2] and sorted(right) == [0, 1, 2]


def test_scales(spark):
    quad = spark.createDataFrame([(1, [[10.0, 10.0], [410.0, 10.0], [410.0, 110.0], [10.0, 110.0]], 640.0, 480.0, 40.0)], "code_id int, polygon array<array<double>>, frame_w double, frame_h double, reference_mm double")
    assert geometry.scale_from_quad(quad).head().scale_px_per_mm == 10.0
    obs = spark.createDataFrame([(1, 7, "width", 2000.0, 1.0), (1, 7, "height", 1000.0, 1.0)], "obs_id int, reference_id int, axis string, px double, px_err double")
    refs = spark.createDataFrame([(7, "width", 100.0, 0.1), (7, "height", 50.0, 0.1)], "reference_id int, axis string, mm double, uncertainty_mm double")
    row = geometry.scale_from_reference(obs, refs).head()
    assert (row.status, row.scale_px_per_mm) == ("CALIBRATED_REVIEW_ONLY", 20.0)


def test_coverage_counts_overlap_once(spark):
    df = spark.createDataFrame([(1, 0, 0, 60, 100, 100, 100), (1, 40, 0, 80, 50, 100, 100), (2, 0, 0, 10, 10, 100, 100), (3, 50, 0, 120, 10, 100, 100)],
                               "doc_id int, x1 int, y1 int, x2 int, y2 int, frame_w int, frame_h int")
    got = {r.doc_id: (r.coverage, r.status) for r in geometry.panel_coverage(df).collect()}
    assert got == {1: (0.7, "eligible"), 2: (0.01, "review_required"), 3: (None, "review_required")}


def test_confidence_gate(spark):
    df = spark.createDataFrame([(0.9, 0.9, 0.9, 0.9), (1.0, 1.0, 0.0, 1.0), (1.2, 1.0, 1.0, 1.0), (0.8, 0.9, 0.9, 0.9)], "a double, b double, c double, d double")
    assert [r.decision for r in metrics.confidence_gate(df, list("abcd")).collect()] == ["proceed", "officer_review", "officer_review", "officer_review"]


def test_instrument_interval_clamps_the_day(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29), "clock")], "last_verified date, instrument_category string")
    assert lots.verification_interval(df, F.lit("2025-02-28").cast("date")).head().expires == dt.date(2025, 2, 28)


def test_merkle_of_fractions_and_large_groups(spark):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(70)]
    df = spark.createDataFrame([("g", 8.25 + i / 4, v) for i, v in reversed(list(enumerate(leaves)))], "g string, i double, leaf string")
    assert [r.merkle_root for r in integrity.merkle_root(df, "g", "i", "leaf", block_bits=2).collect()] == [merkle(leaves)]


def test_merkle_of_short_groups_moves_leaves_once(spark):
    """Long and short groups beside each other; short ones alone are gathered without being numbered first."""
    sizes = {"a": 1, "b": 3, "c": 4, "d": 5, "e": 70}
    leaves = {g: [hashlib.sha256(f"{g}{i}".encode()).hexdigest() for i in range(n)] for g, n in sizes.items()}
    rows = [(g, i * 5000, v) for g, vs in leaves.items() for i, v in reversed(list(enumerate(vs)))] + [(None, 1, "x"), ("b", None, "x")]
    df = spark.createDataFrame(rows, "g string, i bigint, leaf string")
    got = {r.g: r.merkle_root for r in integrity.merkle_root(df, "g", "i", "leaf", block_bits=2).collect()}
    assert got == {g: merkle(vs) for g, vs in leaves.items()}
    short = integrity.merkle_root(df.repartition("g"), "g", "i", "leaf")
    assert {r.g: r.merkle_root for r in short.collect()} == got
    assert short._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


@pytest.mark.parametrize("body", ['{"records": [%s]}', "[%s]", "%s"])
def test_ground_truth_files(spark, tmp_path, body):
    record = '{"product_id": "p", "image_id": "i", "capture_conditions": ["glare"], "expected_fields": {"mrp": "5"}}'
    (tmp_path / "truth.json").write_text(body % record)
    rows, violations = readers.read_ground_truth(spark, str(tmp_path))
    assert [tuple(r) for r in rows.select("image_id", "field", "expected").collect()] == [("i", "mrp", "5")]
    assert violations.count() == 0


def test_meta_attributes_in_every_form(spark):
    html = "<meta property='og:title' content='Single &#8377;'><meta name=brand content=Bare><meta name=\"a\" content=\"it's\">"
    page = listing.page_parts(spark.createDataFrame([(1, html)], "page_id long, html string")).head()
    assert page.meta == {"og:title": "Single ₹", "brand": "Bare", "a": "it's"}
