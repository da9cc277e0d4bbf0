"""Entries found in texts by their rarest window: the same as comparing every text with every entry."""

import random
import time

import pytest
from pyspark.sql import functions as F

from labelwright.operators import lookups, retrieval


def brute(texts, entries):
    return sorted((k, e, n) for k, t in texts if t is not None for e, n in entries if e is not None and e.lower() in t.lower())


@pytest.mark.parametrize("small", [10_000, 0])
def test_contained_entries_are_those_of_brute_force(spark, small):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("abAB é😀") for _ in range(rng.randint(a, b)))
    texts = [(i, word(0, 40)) for i in range(120)] + [(0, "abab"), (0, "abab"), (121, None), (122, "")]
    entries = [(word(0, 7), i) for i in range(90)] + [("", 90), (None, 91), ("ab", 92), ("ab", 93), ("AB", 94)]
    df = spark.createDataFrame(texts, "id int, text string")
    table = spark.createDataFrame(entries, "entry string, no int")
    got = lookups.contained_entries(df, "id", "text", table, "entry", small=small)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, entries)


@pytest.mark.parametrize("small", [10_000, 0])
def test_empty_table_and_empty_texts(spark, small):
    none = spark.createDataFrame([], "entry string, no int")
    some = spark.createDataFrame([("ab", 1)], "entry string, no int")
    texts = spark.createDataFrame([(1, "ab")], "id int, text string")
    assert lookups.contained_entries(texts, "id", "text", none, "entry", small=small).collect() == []
    assert lookups.contained_entries(texts.limit(0), "id", "text", some, "entry", small=small).collect() == []


@pytest.mark.parametrize("small", [10_000, 0])
def test_longest_match_and_ties(spark, small):
    table = spark.createDataFrame([("ring", ["number"]), ("Small Ring", ["mass", "number", "mass"]), ("bolt", ["mass"]), ("nail", ["mass"]), ("NAIL", ["number"])],
                                  "entry string, bases array<string>")
    docs = spark.createDataFrame([(1, "a small RING here"), (2, "ring and bolt"), (3, "a nail"), (4, "nothing"), (5, None), (6, "")], "doc_id int, commodity string")
    got = {r["doc_id"]: (r["entry"], r["bases"]) for r in lookups.longest_match(docs, table, small=small).collect()}
    none = (None, None)
    assert got == {1: ("Small Ring", ["mass", "number"]), 2: none, 3: none, 4: none, 5: none, 6: none}


def test_a_hundred_thousand_entries_meet_few_texts(spark):
    table = spark.range(100_000).select(F.concat(F.lit("stainless steel part "), F.lpad(F.hex(F.xxhash64("id")), 12, "0")).alias("entry"), F.array(F.lit("mass")).alias("bases"))
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("One Stainless Steel Part "), F.lpad(F.hex(F.xxhash64(F.col("id") * 50)), 12, "0"), F.lit(" boxed")).alias("commodity"))
    start = time.time()
    out = lookups.longest_match(docs, table)
    assert out.where("entry is null").count() == 0
    assert "CartesianProduct" not in (plan := out._jdf.queryExecution().toString()) and "BroadcastNestedLoop" not in plan
    assert time.time() - start < 120


def test_queries_are_expanded_by_every_pattern(spark):
    queries = spark.createDataFrame([(1, "Net weight of a pack"), (2, "price"), (3, None), (4, "zz")], "query_id int, text string")
    synonyms = spark.createDataFrame([("net weight", "net quantity"), ("pack", "package"), ("price", "mrp"), ("of a pack", "package"), (None, "never")], "pattern string, expansion string")
    got = {r["query_id"]: (r["text"], r["rewritten"]) for r in retrieval.expand_queries(queries, synonyms).collect()}
    assert got == {1: ("Net weight of a pack net quantity package", True), 2: ("price mrp", True), 3: ("", False), 4: ("zz", False)}
