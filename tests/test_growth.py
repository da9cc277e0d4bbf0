"""What is shuffled and held by queries whose input grows: no raw rows, no pieces that nobody needs."""

import random

import pytest
from pyspark.sql import functions as F

from labelwright.operators import geometry, joins, metrics


def explained(df):
    return df._jdf.queryExecution().toString()


def test_weighted_median_sums_before_it_shuffles(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 5), ("a", 9.0, 1), ("b", 3.0, 1), ("b", 4.0, 1), ("c", None, 2), ("c", None, 2), ("c", None, 2), (None, 1.0, 1), (None, 1.0, 1), (None, 1.0, 1), ("d", 7.0, None), ("d", 8.0, None), ("d", 8.0, None)]
    found = metrics.weighted_median(spark.createDataFrame(rows, "k string, v double, w int"), "k", "v", "w")
    assert {(r["k"], r["value"], r["status"]) for r in found.collect()} == {
        ("a", 2.0, "assessed"), ("b", None, "not_assessed"), ("c", None, "not_assessed"), (None, None, "not_assessed"), ("d", None, "not_assessed")}
    assert "LeftSemi" not in explained(found)  # it took every row to its group's task


def boxes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, x1 double, y1 double, x2 double, y2 double, frame_w double, frame_h double")


@pytest.mark.parametrize("crowded", [0, 3, 256])
def test_coverage_is_the_same_cut_or_not(spark, crowded):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(8):
        own = [(x, y, x + rng.randint(1, 20), y + rng.randint(1, 20)) for x, y in [(rng.randrange(44), rng.randrange(44)) for _ in range(1 + doc)]]
        own += own[:2]
        rows += [(doc, *map(float, b), 64.0, 64.0) for b in own]
        want[doc] = round(len({(x, y) for a, b, c, d in own for x in range(a, c) for y in range(b, d)}) / 4096, 4)
    rows += [(50, 1.0, 1.0, 90.0, 2.0, 64.0, 64.0), (50, 1.0, 1.0, 9.0, 2.0, 64.0, 64.0), (None, 0.0, 0.0, 32.0, 64.0, 64.0, 64.0)]
    got = {r["doc_id"]: r["coverage"] for r in geometry.panel_coverage(boxes(spark, rows), crowded=crowded).collect()}
    assert got.pop(50) is None and got.pop(None) == 0.5
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1.1e-4 for d in want)


def generated(df):
    """Rows that leave the ``explode`` steps of a plan that has run."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.executedPlan()
        if "QueryStage" in plan.nodeName():
            plan = plan.plan()
        if plan.nodeName() == "Generate":
            out += plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return out


def test_an_image_of_few_boxes_is_not_cut(spark):
    frame = boxes(spark, [(d, 0.0, float(y), 60.0, y + 2.0, 64.0, 64.0) for d in range(50) for y in range(10)])
    found = geometry.panel_coverage(frame)
    found.collect()
    assert generated(found) == 500


def test_boxes_meet_in_few_bands(spark):
    """A box goes to the bands it lies in itself; the pairs are those of a plain loop, flat and tall boxes included."""
    rng = random.Random(5)
    kinds = "image_id int, pos int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"
    def side(n):
        made = []
        for i in range(n):
            x, y, h = rng.randrange(120), rng.randrange(500), rng.choice([0, 1, 2, 22, 22, 22, 90, 300])
            made.append((i % 3, i, "t", rng.choice([0.0, 0.9]), x, y, x + rng.randrange(80), y + h))
        return made
    a, b = side(120), side(120)
    one, two = spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds)
    every = one.select("image_id", F.struct(*one.columns[1:]).alias("a")).join(two.select("image_id", F.struct(*two.columns[1:]).alias("b")), "image_id")
    every = every.where("a.confidence > 0 or b.confidence > 0").withColumn("score", joins.geometry_score(F.col("a"), F.col("b")))
    key = lambda r: (r["image_id"], r["a"]["pos"], r["b"]["pos"], r["score"])
    for minimum in (0.01, 0.45):
        want = sorted(map(key, every.where(F.col("score") >= minimum).collect()))
        assert want and sorted(map(key, joins.candidate_pairs(one, two, minimum=minimum).collect())) == want
    lines = [spark.createDataFrame([(i, n, "t", c, 0, 30 * n, 90, 30 * n + 22) for i in range(20) for n in range(16)], kinds) for c in (0.8, 0.9)]
    met = joins.candidate_pairs(*lines)
    assert met.count() == 320
    met.collect()
    assert generated(met) < 2 * 320 * 1.5  # more than two bands a box while boxes reached out by their height


@pytest.mark.parametrize("a, b, likeness", [("MRP  199", "mrp 199 ", 1.0), ("", "x", 0.0), (" ", "", 1.0), ("abcd", "ABXD", 0.75), (None, "x", None)])
def test_likeness_of_texts(spark, a, b, likeness):
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    assert frame.select(joins.text_similarity(F.col("a"), F.col("b")).alias("s")).first()["s"] == likeness
