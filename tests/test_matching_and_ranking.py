"""Greedy matching in rounds and keyword search over posting blocks, against plain loops."""

import math
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from labelwright.operators import joins, retrieval


def greedy(pairs):
    left, right, out = set(), set(), []
    for score, l, r in sorted(pairs, reverse=True):
        if l not in left and r not in right:
            left.add(l)
            right.add(r)
            out.append((l, r))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_choose_what_greedy_does(spark, seed):
    rng = random.Random(seed)
    images = {i: list({(l, r): (rng.choice([0.5, 0.6, 0.7, rng.random()]), l, r) for l, r in [(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)]}.values()) for i, n in enumerate((1, 4, 30, 60))}
    images[9] = [(1 - k / 100, (k + 1) // 2, k // 2) for k in range(24)]  # a chain: each pair is better than the next and shares a box with it
    rows = [(i, l, r, s) for i, pairs in images.items() for s, l, r in pairs]
    rng.shuffle(rows)
    got = joins.dominant_pairs(spark.createDataFrame(rows, "image_id int, l int, r int, score double")).collect()
    for i, pairs in images.items():
        assert sorted((r["l"], r["r"]) for r in got if r["image_id"] == i) == greedy(pairs)
    none = spark.createDataFrame([], "image_id int, l int, r int, score double")
    assert joins.dominant_pairs(none).count() == 0


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image_id int, pos int, text string, confidence double, x1 int, y1 int, x2 int, y2 int")


def test_matches_carry_both_readings(spark):
    a = boxes(spark, [(1, 0, "MRP 199", 0.9, 10, 10, 110, 40), (2, 0, "alone", 0.5, 0, 0, 9, 9), (1, 1, "zero", 0.0, 10, 300, 110, 340)])
    b = boxes(spark, [(1, 0, "MRP  299", 0.3, 12, 11, 111, 41), (3, 0, "second", 0.5, 0, 0, 9, 9), (1, 1, "zero", 0.0, 10, 300, 110, 340)])
    matched = joins.match_boxes(a, b)
    pair = matched.where("image_id = 1 and left_pos = 0").first()
    assert (pair.status, pair.text, pair.confidence, pair.other_text, pair.other_confidence) == ("disagreement", "MRP 199", 0.9, "MRP  299", 0.3)
    assert (pair.x1, pair.y1, pair.x2, pair.y2) == (10, 10, 110, 40) and 0.8 < pair.iou < 1 and pair.text_similarity == round(1 - 1 / 7, 4)
    assert matched.where("image_id = 1").count() == 3  # two boxes without confidence are no evidence for each other
    rows = {(r.image_id, r.left_text, r.right_text, r.right_confidence) for r in joins.disagreements(matched).collect()}
    assert rows == {(1, "MRP 199", "MRP  299", 0.3), (1, None, "zero", 0.0), (3, None, "second", 0.5)}
    images = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "image_id int")
    got = {r.image_id: (r["mode"], r.regions, r.disagreements, r.status) for r in joins.ensemble_summary(matched, images).collect()}
    assert got == {1: ("comparison_review_only", 3, 2, "review_required"), 2: ("primary_only", 1, 0, "ok"), 3: ("secondary_only_review", 1, 1, "review_required"), 4: ("no_data", 0, 0, "ok")}


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain_bm25(queries, passages, k):
    tokened = {i: words(t) for i, t in passages}
    average = sum(len(w) for i, w in tokened.items()) / len(tokened)
    out = []
    for q, text in queries:
        scored = []
        for i, w in tokened.items():
            total = 0.0
            for term in sorted(set(words(text))):
                held = sum(term in x for x in tokened.values())
                times = w.count(term)
                total += math.log(1 + (len(tokened) - held + 0.5) / (held + 0.5)) * times * 2.5 / (times + 1.5 * (0.25 + 0.75 * len(w) / average))
            if total > 0:
                scored.append((-round(total, 6), i))
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("k, terms, batch", [(3, 10 ** 6, 10_000), (5, 40, 17), (1, 10 ** 6, 3)])
def test_bm25_against_a_plain_loop(spark, k, terms, batch):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(rng.expovariate(0.12)))] for _ in range(n))
    passages = [(i, text(rng.randint(1, 60))) for i in range(150)] + [(200, ""), (201, "other, words!"), (202, "Other words")]
    queries = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(50, ""), (51, "nowhere"), (52, "OTHER"), (53, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = retrieval.bm25(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(passages, "passage_id long, text string"), k, query_terms=terms).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["query_id"], r["passage_id"], round(r["score"], 5), r["rank"]) for r in got) == sorted((q, i, round(s, 5), n) for q, i, s, n in plain_bm25(queries, passages, k))


def test_bm25_of_text_ids_and_empty_tables(spark):
    queries, passages = spark.createDataFrame([("q", "one two")], "query_id string, text string"), spark.createDataFrame([("b", "one"), ("a", "one"), ("c", None)], "passage_id string, text string")
    assert [(r["passage_id"], r["rank"]) for r in retrieval.bm25(queries, passages, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert retrieval.bm25(queries.where("false"), passages).count() == 0 and retrieval.bm25(queries, passages.where("false")).count() == 0


def test_blocks_rule_out_most_passages():
    """A rare word decides; the lists of frequent ones are looked up only for the few that have it."""
    rng = np.random.default_rng(0)
    n, parts = 20_000, []
    for term, size in enumerate((12, 9_000, 15_000, 18_000)):
        docs = np.sort(rng.choice(n, size, replace=False))
        parts.append((np.full(size, term), docs, rng.integers(1, 4, size)))
    lengths, idf = rng.integers(50, 60, n).astype(float), np.array([9.0, 0.4, 0.2, 0.1])
    shard = retrieval.Postings(*(np.concatenate(x) for x in zip(*parts)), lengths, idf, 55.0)
    some, scores = shard.best(np.arange(4), 5, 0.0)
    whole = shard.scores(np.arange(4), np.arange(n))
    assert set(np.argsort(-whole)[:5]) <= set(some) and len(some) < 20 and np.allclose(whole[some], scores)
    assert len(shard.best(np.arange(4), 5, whole.max() + 1)[0]) == 0


def test_shards_hold_a_bounded_number_of_words():
    """Postings of a batch come in slices, however many passages the batch holds; one long passage stays whole."""
    texts = [["a", "b"] * (i % 5) for i in range(200)] + [["a"] * 90, None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["id", "_t"])
    shards = [b.to_pylist()[0] for b in retrieval._shards(SimpleNamespace(value=["a", "zz"]), "id", pa.int64(), 50)(iter([batch]))]
    assert [i for s in shards for i in s["ids"]] == list(range(len(texts)))
    assert all(sum(n or 0 for n in s["lengths"]) <= 50 or len(s["ids"]) == 1 for s in shards) and len(shards) > 10
    got = {s["ids"][d]: n for s in shards for d, n in zip(s["docs"], s["times"])}
    assert got == {i: t.count("a") for i, t in enumerate(texts) if t and "a" in t}


def test_a_pair_of_blocks_is_scored_in_bounded_memory():
    rng = np.random.default_rng(1)
    frame = lambda n, first: pd.DataFrame({"id": np.arange(first, first + n), "vec": list(rng.normal(size=(n, 8)).astype("float32"))})
    vectors, queries = frame(20_000, 0), frame(1_000, 5_000)
    tracemalloc.start()
    got = retrieval._block_scorer(3, "query_id", "vec_id")(vectors, queries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all scores at once are 160 MB, twice while they are rounded
    unit = lambda f: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(np.stack(f["vec"]).astype(float))
    whole = np.round(unit(queries)[::50] @ unit(vectors).T, 6)
    for q, row in zip(queries["id"][::50], whole):
        assert got[got["query_id"] == q][["vec_id", "score"]].values.tolist() == [[i, row[i]] for i in np.lexsort((np.arange(len(row)), -row))[:3]]
