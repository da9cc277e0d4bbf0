"""Held-out accuracy of the classifiers, and their odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright.llm import language, quality
from labelwright.llm.queries import QUERIES
from tests.llm.cases import no_documents, odd_documents

PATH = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op3_quality"](spark, PATH).join(spark.read.parquet(f"{PATH}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_quality_is_the_plain_discriminant(spark):
    """The score against densities computed from the same covariances with a general solver."""
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = np.vstack([rng.normal(0, 1, (80, d)), rng.normal(0.7, 2, (90, d))])
    y = [0] * 80 + [1] * 90
    frame = spark.createDataFrame([(row.tolist(), label) for row, label in zip(x, y)], "x array<double>, y int")
    model = quality.fit(frame, "x", "y")
    means, covs = [], []
    for c in (0, 1):
        part = x[np.array(y) == c]
        means.append(part.mean(0))
        covs.append(np.cov(part.T, bias=True))
    common = (80 * covs[0] + 90 * covs[1]) / 170
    density = []
    for mean, cov in zip(means, covs):
        full = (1 - quality.SHRINK) * ((1 - quality.POOL) * cov + quality.POOL * common) + quality.SHRINK * np.diag(np.diag(common))
        diff = x - mean
        density.append(-0.5 * np.einsum("ij,ij->i", diff, np.linalg.solve(full, diff.T).T) - 0.5 * np.linalg.slogdet(full)[1])
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0] + np.log(90 / 80), -40, 40)))
    assert np.allclose(model.scores(x), want, atol=1e-6)


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(4, 1)], 1.0), ([(4, 0), (4, None), (None, 1)], 0.0)])
def test_quality_of_odd_rows(spark, labels, score):
    featured, name = quality.with_features(odd_documents(spark))
    model = quality.fit_on_labels(featured, name, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = featured.select(quality.score_column(F.col(name), model).alias("s")).collect()
    assert len(rows) == 13 and all(abs(r["s"] - score) < 1e-9 for r in rows)
    empty, name = quality.with_features(no_documents(spark))
    assert empty.select(quality.score_column(F.col(name), model)).count() == 0


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op5_language"](spark, PATH).join(spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    model = language.fit(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars between 2000 and 3000").collect()}
    mixed = texts["de"][:1500] + " " + texts["fr"][:1500]
    chosen, shares = model.infer(language.trigram_counts(mixed))
    assert {model.names[c] for c in chosen} == {"de", "fr"} and min(shares) > 0.35
    for name, text in texts.items():
        chosen, _ = model.infer(language.trigram_counts(text))
        assert [model.names[c] for c in chosen] == [name]


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = language.predict(docs, language.fit(docs)).collect()
    assert len(rows) == 13
    assert all((r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"])) for r in rows)
    none = language.fit(no_documents(spark))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(no_documents(spark), none).count() == 0


def test_trigrams_of_long_texts_are_those_of_its_blocks(monkeypatch):
    text = "ab cde fgh " * 500
    whole = language.trigram_counts(text)
    monkeypatch.setattr(language, "_BLOCK", 17)
    assert (language.trigram_counts(text) == whole).all()


def plain_trigrams(text):
    """Places of the trigrams, from integers without wrap-around tricks."""
    out, at, clean = {}, 1 << 64, " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for i in range(len(clean) - 2):
        h = sum(ord(c) * k for c, k in zip(clean[i:i + 3], (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) % at
        bucket = (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % at) >> 40) % language.BUCKETS
        out[bucket] = out.get(bucket, 0) + 1
    return out


def plain_mixture(counts, p, shares):
    """Shares by expectation-maximisation and the log-likelihood, one trigram at a time."""
    n = sum(counts.values())
    for _ in range(language.ROUNDS):
        moved = [0.0] * len(shares)
        for b, c in counts.items():
            parts = [s * q[b] for s, q in zip(shares, p)]
            for k, x in enumerate(parts):
                moved[k] += c * x / sum(parts) / n
        done = max(abs(a - b) for a, b in zip(moved, shares)) < 1e-4
        shares = moved
        if done:
            break
    return shares, sum(c * math.log(sum(s * q[b] for s, q in zip(shares, p))) for b, c in counts.items())


def test_language_mixtures_against_plain_inference(spark):
    """Counts, likelihoods, shares and the penalised choice of the set, for single and mixed texts."""
    given = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    learnt = [(i, t, l) for i, t, l in given if l is not None and i % 3]
    model = language.fit(spark.createDataFrame(learnt, "doc_id long, text string, lang string"))
    seen = {l: [language.SMOOTHING] * language.BUCKETS for _, _, l in learnt}
    for _, t, l in learnt:
        for b, c in plain_trigrams(t).items():
            seen[l][b] += c
    names = sorted(seen)
    p = [[c / sum(seen[l]) for c in seen[l]] for l in names]
    by_lang = {l: [t[:1500] for _, t, k in given if k == l and len(t) > 600] for l in names}
    texts = [by_lang[l][0] for l in names] + [by_lang[a][1] + " " + by_lang[b][2][:700] for a, b in zip(names, names[1:] + names[:1])] + ["Straße x y z", "a1b2"]
    rows = language.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).collect()
    several = 0
    for r in rows:
        counts = plain_trigrams(texts[r["i"]])
        n = sum(counts.values())
        single = [sum(c * math.log(q[b]) for b, c in counts.items()) for q in p]
        chosen, shares, likelihood = [single.index(max(single))], [1.0], max(single)
        cost = language.PENALTY * 0.5 * math.log(max(n, 2))
        while len(chosen) < len(names):
            rise = [-1e300 if k in chosen else sum(c * q[b] / sum(s * p[j][b] for s, j in zip(shares, chosen)) for b, c in counts.items()) - n for k, q in enumerate(p)]
            best = rise.index(max(rise))
            if rise[best] <= cost:
                break
            trial, reached = plain_mixture(counts, [p[k] for k in [*chosen, best]], [*(s * 0.9 for s in shares), 0.1])
            if reached - likelihood <= cost:
                break
            chosen, shares, likelihood = [*chosen, best], trial, reached
        several += len(chosen) > 1
        assert set(r["languages"]) == {names[k] for k in chosen}
        assert all(abs(r["languages"][names[k]] - s) < 1e-6 for k, s in zip(chosen, shares)) and abs(r["score"] - max(shares)) < 1e-6
    assert several >= len(names) - 1
