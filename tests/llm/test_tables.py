"""Queries with a SQL twin, mixing, search and URLs on odd rows, and the pipeline stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelwright.llm import line_dedup, mixing, quality, topk, url_filter
from labelwright.llm.queries import QUERIES
from labelwright.llm.twins import ORACLES
from tests.llm.cases import no_documents, odd_documents
from tests.llm.test_copies import brute_lines, brute_links
from tests.oracle_harness import compare, connect

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    problem, n = compare(spark, connect(PATH), name, QUERIES[name], ORACLES[name], PATH)
    assert problem is None and n, problem


def brute_targets(sizes):
    """Share, stop what is above, share its excess among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(names, [3, 1, 2] * len(names)))
    left, total, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        above = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not above:
            target.update({s: weight[s] * level for s in left})
            break
        target.update({s: 2.0 * sizes[s] for s in above})
        total -= sum(2 * sizes[s] for s in above)
        left -= above
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "Z", "é", None, "a"] if seed else ["b", "b", "b", "c", None])) for i in range(400)]
    rows += [(1000, "x " * 5000, "big"), (1001, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, buckets=rng.choice([1, 7, 1024])).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    mixed = mixing.apply_mix(docs, mixing.mix_sources(docs))
    words = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert all(abs(words.get(s, 0) - want[s]) <= 0.5 + 1e-6 for s in sizes)


def test_better_documents_come_first(spark):
    rows = [(i, ("clean words here " if i % 2 else "noisy$$$ words### here%%% ") * 20, "s") for i in range(2000)] + [(9999, "other " * 100_000, "t")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 20.0)).where("doc_id < 9999").collect()
    share = lambda odd: np.mean([r["taken"] / r["size"] for r in got if r["doc_id"] % 2 == odd])
    assert 1 < share(0) and share(1) - 1 > 2 * (share(0) - 1)  # one whole epoch, then a choice


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    assert mixing.mix_sources(docs).count() == 13
    assert mixing.mix_sources(no_documents(spark)).count() == 0
    assert mixing.apply_mix(docs, mixing.mix_sources(docs)).columns == docs.columns


def brute_top(rows, k):
    fine = {i: np.floor(np.array(v, np.float64) * 256).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in fine:
        if q % 50 == 0:
            scored = sorted(((-int(fine[q] @ fine[c]), c) for c in fine if c != q and len(fine[c]) == len(fine[q])))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard, block, leaf", [(16_384, 4096, 512), (60, 3, 4), (1, 1, 1)])
def test_top_k_against_brute_force(spark, shard, block, leaf, monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 5).round(1).tolist()) for i in range(0, 400, 3 if shard == 1 else 1)]
    rows += [(i + 1000, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(20)] + [(2000, None), (2050, [None, 1.0, 1.0, 1.0, 1.0]), (2051, [float("nan")] * 5), (2052, [float("inf")] * 5), (None, [1.0] * 5),
                                                                         (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (2150, []), (2200, [3e4] * 5)]
    frame = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("_v", F.lit(2))
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, shard_rows=shard, query_rows=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5)
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


URLS = [None, "", "no scheme", "http://", "HTTP://Www.Example.ORG/es/1", "http://example.org/en/12?x#y", "http://a.org", "http://a.org/", "http://b.com/fr/casino", "http://b.com/de/",
        "http://x.net/casino", "http://x.net/casinos", "http://x.net/cheap-FREE", "http://x.net/cheap", "http://x.net/free/free", "http://notexample.org/es/", "http://x.net?cheap#win",
        "http://x.net/ÄXXX", "a://b://c/d", "http://m.free-bets.example.net/a\nb"]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS)], "page_id long, url string, Rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(frame).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.org", "/es/1", "example.org/es/", "block") and got[5] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[6] == ("a.org", "", None, "allow") and got[7] == ("a.org", "/", "org/", "allow")
    assert got[8][2:] == ("com/fr/", "allow") and got[9][2:] == ("com/de/", "block")
    assert [got[i][3] for i in range(10, 17)] == ["block", "allow", "block", "allow", "allow", "allow", "block"]
    assert got[15][2] == "org/" and got[18][:2] == ("b:", "//c/d") and got[19][1] == "/a\nb" and got[19][3] == "block"
    assert url_filter.judge_urls(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(frame, soft={"a": 2.0})


def test_urls_by_a_vocabulary_of_thousands(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghé1-") for _ in range(rng.randint(3, 7)))
    terms = [(word().title(), rng.choice([None, 1.0, *[0.5] * 20, *[0.25] * 30])) for _ in range(6000)] + [("", 1.0), (None, None)]
    urls = ["http://x.net/" + "/".join(rng.choice(terms[:-2])[0] if rng.random() < 0.6 else word() for _ in range(rng.randint(1, 7))) for _ in range(400)]
    strict, soft = set(), {}
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    for t, w in terms:
        if t and w is None:
            strict.add(fold(t))
    for t, w in terms:
        if t and w is not None and fold(t) not in strict:
            soft[fold(t)] = max(w, soft.get(fold(t), 0))
    table = spark.createDataFrame(terms, "term string, weight double")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules=(), vocabulary=table).collect()}
    wordly = lambda c: c in "abcdefghijklmnopqrstuvwxyz0123456789"
    for i, url in enumerate(urls):
        low, hits, found = fold(url), 0, set()
        for a in range(len(low)):
            for b in range(a + 1, min(len(low), a + 7) + 1):
                if (a == 0 or not wordly(low[a - 1])) and (b == len(low) or not wordly(low[b])):
                    hits += low[a:b] in strict
                    found |= {low[a:b]} & set(soft)
        weight = sum(soft[t] for t in found)
        assert (got[i]["strict_hits"], got[i]["soft_terms"], got[i]["soft_weight"]) == (hits, len(found), weight)
        assert got[i]["verdict"] == ("block" if hits or weight >= url_filter.SOFT_LIMIT else "allow")
    assert len({r["verdict"] for r in got.values()}) == 2 and len(soft) > 3000 and sum(r["strict_hits"] == 0 for r in got.values()) > 200
    with pytest.raises(ValueError):
        url_filter.read_vocabulary(table, max_bytes=1000)


def test_urls_as_sql(spark, tmp_path):
    import duckdb
    spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    problem, _ = compare(spark, con, "op10_url_filter", QUERIES["op10_url_filter"], ORACLES["op10_url_filter"], str(tmp_path))
    assert problem is None, problem


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").cache()
    (_, keep), (_, cut), (_, one), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    first = keep(spark, docs, PATH)
    featured, name = quality.with_features(docs)
    model = quality.fit_on_labels(featured, name, spark.read.parquet(f"{PATH}/labels.parquet"))
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in featured.collect() if model.scores(np.array([r[name]]))[0] >= 0.5}
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    second = cut(spark, first, PATH).cache()
    emptied = lambda i, t: t != dict(rows)[i] and not t.split()
    assert sorted((r["doc_id"], r["text"]) for r in second.collect()) == [(i, t) for i, t, _ in brute_lines(rows, line_dedup.MIN_LETTERS) if not emptied(i, t)]
    third = one(spark, second, PATH).cache()
    linked = brute_links([(r["doc_id"], r["text"]) for r in second.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(i for i, n, c in linked if i == c)
    fourth = mix(spark, third, PATH).cache()
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(third).where("taken > 0").collect()}
    assert {r["doc_id"]: r["n"] for r in fourth.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()} == want
    for stage in (first, second, third, fourth):
        assert stage.dtypes == docs.dtypes
    assert fourth.where("n_chars <> length(text)").count() == 0
    last = tokens(spark, fourth, PATH)
    assert last.where("not round_trip").count() == 0 and last.count() == fourth.count()


def test_near_copies_leave_the_pipeline(spark):
    """What is left of copies and near copies of earlier documents behind line dedup and the join."""
    (_, _), (_, cut), (_, one), *_ = corpus_pipeline.STAGES
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    later = [i for i, n, c in brute_links(rows, corpus_pipeline.WIDTH, corpus_pipeline.PERCENT) if i != c]
    left = {r["doc_id"]: len(r["text"].split()) for r in one(spark, cut(spark, docs, path), path).collect()}
    words = {i: len(t.split()) for i, t in rows}
    caught = [i for i in later if left.get(i, 0) <= 0.2 * words[i]]
    assert len(later) > 50 and len(caught) >= 0.9 * len(later)


def test_pipeline_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(4, 1), (8, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_documents(spark), no_documents(spark)):
        for _name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()
