"""Languages of a document by mixture inference over hashed character trigrams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigrams fall into so many buckets; the model has this many numbers per language.
BUCKETS = 1 << 13
MAX_LANGUAGES = 1000
SMOOTHING = 0.5
ROUNDS = 30
#: A language joins the set if it raises the log-likelihood by more than this many times half the logarithm of the trigrams.
PENALTY = 8.0
_BLOCK = 1 << 20
_NO_LETTERS = re.compile(r"[\W\d_]+")


def trigram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts per bucket of the trigrams of lower-cased letters, runs of anything else being one space."""
    total = np.zeros(buckets, np.int64)
    clean = " " + _NO_LETTERS.sub(" ", text.lower()).strip() + " "
    for start in range(0, len(clean) - 2, _BLOCK):
        codes = np.frombuffer(clean[start:start + _BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)
        total += np.bincount(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray

    def infer(self, counts: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
        """The chosen languages and their shares.

        Starts from the most likely single language and adds the one by which the log-likelihood rises most steeply, as
        long as that of the mixture, its shares found by expectation-maximisation, pays the penalty. Of equal languages
        the first by name is taken.
        """
        at = np.flatnonzero(counts)
        n, log_p = counts[at].astype(np.float64), self.log_p[:, at]
        p, total = np.exp(log_p), n.sum()
        single = log_p @ n
        chosen, shares = [int(single.argmax())], np.ones(1)
        likelihood = single[chosen[0]]
        cost = penalty * 0.5 * np.log(max(total, 2.0))
        while len(chosen) < len(self.names):
            # rise of the log-likelihood per unit of share, at a share of nothing: who can't rise isn't tried
            ratio = (p / (shares @ p[chosen])) @ n - total
            ratio[chosen] = -np.inf
            best = int(ratio.argmax())
            if ratio[best] <= cost:
                break
            trial = [*chosen, best]
            mixed, reached = self._mixture(p[trial], n, np.append(shares * 0.9, 0.1))
            if reached - likelihood <= cost:
                break
            chosen, shares, likelihood = trial, mixed, reached
        return chosen, shares

    @staticmethod
    def _mixture(p: np.ndarray, n: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(ROUNDS):
            parts = shares[:, None] * p
            moved = (parts / parts.sum(0)) @ n / n.sum()
            done = np.abs(moved - shares).max() < 1e-4
            shares = moved
            if done:
                break
        return shares, float(np.log(shares @ p) @ n)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Languages:
    """From every row with a text and a language. Rows repeated count as often as they occur.

    Each task adds up one table of counts per language it meets, Spark adds the tables; the driver gets languages times
    buckets numbers, and more than ``MAX_LANGUAGES`` languages are refused.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0), batch.column(1).to_pylist()):
                if name not in sums:
                    sums[name] = np.zeros(buckets, np.int64)
                    if len(sums) > MAX_LANGUAGES:
                        raise ValueError("more languages than the model allows")
                sums[name] += trigram_counts(t.as_py(), buckets)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = rows.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("t")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(table) > MAX_LANGUAGES:
        raise ValueError("more languages than the model allows")
    counts = np.full((len(table), buckets), SMOOTHING)
    for i, row in enumerate(table):
        counts[i, [b for b, _ in row["t"]]] += [n for _, n in row["t"]]
    names = [row["lang"] for row in table]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Languages([names[i] for i in order], np.log(counts / counts.sum(1, keepdims=True))[order] if names else np.zeros((0, buckets)))


SCHEMA = "struct<lang_pred:string,score:double,languages:map<string,double>>"


def predict_column(text: Column, model, buckets: int = BUCKETS) -> Column:
    """lang_pred, its share as score, and the shares of all languages found. ``model`` is a broadcast ``Languages``.

    A text that is null or has no letter, and any text without a learnt language, is ``und`` with score 0.
    """
    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = model.value
        for texts in batches:
            names, scores, shares = [], [], []
            for t in texts:
                text = t.as_py()
                if not known.names or not has_letter(text):
                    names.append("und")
                    scores.append(0.0)
                    shares.append([])
                    continue
                chosen, part = known.infer(trigram_counts(text, buckets))
                first = max(range(len(chosen)), key=lambda i: (part[i], -chosen[i]))
                names.append(known.names[chosen[first]])
                scores.append(min(1.0, float(part[first])))
                shares.append([(known.names[c], float(s)) for c, s in zip(chosen, part)])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                                             ["lang_pred", "score", "languages"])
    return run(text)


def predict(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score and languages (columns of these names are replaced). Every row is judged alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES times the buckets
    made = ("lang_pred", "score", "languages")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return docs.select(*kept, predict_column(F.col(f"`{text}`"), shared).alias("score")).select(*kept, "score.*")
