"""Quality of documents by a regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import buffers, fresh

#: Statistics of a text, in the order of the feature vector; shares are transformed by a logit, counts by a logarithm.
FEATURES = ("bytes", "words", "word_length", "letters", "digits", "capitals", "marks", "odd_marks", "bars", "distinct_words", "top_word", "lines", "repeated_lines", "line_words",
            "sentence_ends", "byte_entropy")
SHRINK = 0.05
POOL = 0.2


def _logit(share: float) -> float:
    share = min(max(share, 0.0), 1.0)
    return float(np.log((share + 0.005) / (1.005 - share)))


def statistics(raw: bytes) -> list[float]:
    """The feature vector of one text."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = raw.split()
    n_words = max(1, len(words))
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    capitals, small, wide = counts[65:91].sum(), counts[97:123].sum(), counts[128:].sum()
    digits = counts[48:58].sum()
    marks = counts[33:127].sum() - capitals - small - digits
    usual = counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    present = counts[counts > 0] / n
    return [np.log1p(len(raw)), np.log1p(len(words)), np.log1p(n / n_words), _logit((capitals + small + wide) / n), _logit(digits / n), _logit(capitals / n), _logit(marks / n),
            _logit((marks - usual) / n), _logit(counts[[124, 33]].sum() / n_words), _logit(len(often) / n_words), _logit(max(often.values(), default=0) / n_words), np.log1p(len(lines)),
            _logit(1 - len(set(lines)) / n_lines), np.log1p(len(words) / n_lines), _logit(min(1.0, counts[[33, 46, 63]].sum() / n_words)), float(-(present * np.log(present)).sum())]


def features_column(text: Column) -> Column:
    """array<double> of ``FEATURES``; a null text counts as empty."""
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = buffers(texts)
            rows = [statistics(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            flat = np.array(rows, np.float64).reshape(-1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat))
    return run(text)


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log-determinants of both classes, and the log-odds of their shares."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of the log-densities plus the prior log-odds."""
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            whitened = (x - mean) @ factor.T
            density.append(-0.5 * (whitened ** 2).sum(1) - 0.5 * log_det)
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -40, 40)))


def fit(labelled: DataFrame, features: str, label: str, shrink: float = SHRINK, pool: float = POOL) -> Discriminant:
    """From rows of (features, label 0 or 1); others are passed over. Repeated rows count as often as they occur.

    Spark sums counts, vectors and products per class; two small matrices reach the driver. A class's covariance is
    mixed with the common one by ``pool`` and with a multiple of the identity by ``shrink``. Without rows of a class
    the score is the other class's label, without any rows 0.5.
    """
    d = len(FEATURES)
    x = F.col(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("label")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(x[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p"))
    found = {r["label"]: r for r in sums.collect()}
    if len(found) < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), (40.0 if 1 in found else -40.0) if found else 0.0)
    n = [found[c]["n"] for c in (0, 1)]
    means, covariances = [], []
    for c in (0, 1):
        mean = np.array(found[c]["s"]) / n[c]
        product = np.zeros((d, d))
        for (i, j), v in zip(pairs, found[c]["p"]):
            product[i, j] = product[j, i] = v / n[c]
        means.append(mean)
        covariances.append(product - np.outer(mean, mean))
    common = (n[0] * covariances[0] + n[1] * covariances[1]) / sum(n)
    scale = np.diag(np.maximum(np.diag(common), 1e-6))
    factors, log_dets = [], []
    for covariance in covariances:
        shrunk = (1 - shrink) * ((1 - pool) * covariance + pool * common) + shrink * scale
        lower = np.linalg.cholesky(shrunk + 1e-9 * np.eye(d))
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(log_dets), float(np.log(n[1] / n[0])))


def score_column(features: Column, model: Discriminant) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(FEATURES))
            yield pa.array(model.scores(x))
    return run(features)


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` plus the feature vector, and the name it got."""
    name = fresh(docs, "features")
    return docs.withColumn(name, features_column(F.col(f"`{text}`"))), name


def fit_on_labels(featured: DataFrame, features: str, labels: DataFrame, doc_id: str = "doc_id", keep: Column | None = None) -> Discriminant:
    """Fit on the documents that ``labels(doc_id, quality)`` covers; ``keep`` limits the rows learnt from.

    A document with several labels counts once for each; null ids and null labels teach nothing.
    """
    rows = featured if keep is None else featured.where(keep)
    learnt = rows.select(F.col(f"`{doc_id}`").alias("_id"), F.col(features).alias("_x")).join(labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")), "_id")
    return fit(learnt, "_x", "_y")
