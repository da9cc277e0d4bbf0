"""Regions that override fields, with the parts read from their text."""

from labelwright.operators import evidence

FIELDS = "doc_id int, field string, value string, confidence double"
REGIONS = "doc_id int, pos int, class_name string, detection_confidence double, full_text string, confidence double"


def overlaid(spark, fields, regions):
    out = evidence.overlay_regions(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(regions, REGIONS))
    return {(r["doc_id"], r["field"]): r for r in out.collect()}


def test_care_region_is_read_for_telephone_and_mail(spark):
    out = overlaid(spark, [], [(1, 0, "consumer_care", 0.9, " For Feedback: 1800-123-4567 care@example.com\n", 0.8)])
    care = out[1, "consumer_care_details"]
    assert (care["care_telephone_number"], care["care_email_address"]) == ("1800-123-4567", "care@example.com")
    assert care["care_address"] == care["value"] == "For Feedback: 1800-123-4567 care@example.com"
    assert (care["detected"], care["region_ids"], care["source"]) == (True, ["yolo_consumer_care"], "region")


def test_one_region_fills_every_field_of_its_class_and_no_other(spark):
    out = overlaid(spark, [(1, "unit_sale_price", "Rs 5/kg", 0.7)], [(1, 0, "entity_details", 0.9, "Manufactured by ABC Foods", 0.8)])
    assert {f for _, f in out} == {"unit_sale_price", "manufacturer_packer_importer_details", "name_and_address_of_manufacturer_or_packer"}
    kept = out[1, "unit_sale_price"]
    assert (kept["value"], kept["detected"], kept["region_ids"], kept["source"], kept["care_address"]) == ("Rs 5/kg", True, [], "page", None)


def test_most_confident_region_wins_and_the_earliest_on_ties(spark):
    out = overlaid(spark, [], [(1, 0, "mrp", 0.5, "MRP Rs. 99", 0.9), (1, 1, "mrp", 0.9, "MRP Rs. 450", 0.4), (1, 2, "mrp", 0.9, "MRP Rs. 7", 0.9),
                               (2, 0, "mrp", None, "MRP Rs. 1", 0.9), (2, 1, "mrp", 0.1, "MRP Rs. 2", 0.9)])
    assert out[1, "maximum_retail_price_mrp"]["value"] == "MRP Rs. 450"
    assert out[2, "maximum_retail_price_mrp"]["value"] == "MRP Rs. 2"


def test_region_without_text_takes_the_field_away(spark):
    out = overlaid(spark, [(1, "maximum_retail_price_mrp", "MRP Rs. 3", 0.9)], [(1, 0, "mrp", 0.9, " \t", 0.3), (1, 1, "dog", 0.9, "bark", 0.9), (1, 2, None, 0.9, "x", 0.9)])
    assert len(out) == 1
    gone = out[1, "maximum_retail_price_mrp"]
    assert (gone["value"], gone["detected"], gone["confidence"], gone["region_ids"], gone["source"]) == (None, False, 0.3, [], "region")


def test_batch_and_expiry_from_the_date_region(spark):
    rows = [(1, 0, "mfg_date_batch", 0.9, "PKD. 12/05/2024 BATCH No. A05124C1 USE BY 11/11/2024", 0.8), (2, 0, "mfg_date_batch", 0.9, "PKD. 12/05/2024", 0.8),
            (3, 0, "mfg_date_batch", 0.9, "Best before: 6 months from packaging ", 0.8), (4, 0, "mrp", 0.9, "batch no. XX99", 0.8), (5, 0, "mfg_date_batch", 0.9, None, 0.8)]
    got = {tuple(r) for r in evidence.region_metadata(spark.createDataFrame(rows, REGIONS)).collect()}
    assert got == {(1, "A05124C1", "11/11/2024"), (3, None, "6 months from packaging")}
