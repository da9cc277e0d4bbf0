"""URL verdicts: host and path rules first, then a weighted vocabulary found with one Aho-Corasick pass."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these words in a URL is enough.
STRICT = ("casino", "pills", "viagra", "porn", "xxx", "bets", "spam", "warez", "phishing", "malware", "escort", "payday")
#: Distinct words of these add up; a weight is at most 1, so that several are needed.
SOFT = {"cheap": 1.0, "free": 1.0, "win": 1.0, "farm": 0.5, "ads": 1.0, "ad": 0.5, "track": 1.0, "bonus": 1.0, "click": 1.0, "deals": 0.5,
        "loan": 1.0, "adult": 1.0, "hot": 0.5, "promo": 0.5, "popup": 1.0, "torrent": 1.0}
SOFT_LIMIT = 2.0
VOCABULARY_BYTES = 64 << 20
#: (host, path, verdict): the host and all its subdomains, paths that start with the path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "struct<rule:string,verdict:string,strict_hits:int,soft_terms:int,soft_weight:double>"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def read_vocabulary(terms: DataFrame, term: str = "term", weight: str = "weight", max_bytes: int = VOCABULARY_BYTES) -> tuple[tuple[str, ...], dict[str, float]]:
    """Strict words (weight null) and soft ones with their weights, from a table; its size is measured before it is read.

    A-Z of terms are lower-cased, empty and null terms dropped; of a term that comes several times the largest weight
    counts, and it is strict if it is so once. More than ``max_bytes`` of distinct terms are refused.
    """
    known = terms.select(F.translate(F.col(term), UPPER, LOWER).alias("t"), F.col(weight).cast("double").alias("w")).where("t <> ''")
    known = known.groupBy("t").agg(F.max("w").alias("w"), F.bool_or(F.col("w").isNull()).alias("strict"))
    size = known.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"a vocabulary of {size} bytes is more than the {max_bytes} that every task may hold")
    rows = known.collect()
    return tuple(sorted(r["t"] for r in rows if r["strict"])), {r["t"]: r["w"] for r in rows if not r["strict"]}


def _judge(words, soft_limit: float, rules):
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))

    def fitting(host: str, path: str):
        """The longest rule of the host or a domain above it; of equal lengths the first by code point."""
        found, at = [], 0
        while True:
            name = host[at:]
            found += [(-len(name + p), name + p, v) for p, v in by_host.get(name, ()) if path.startswith(p)]
            dot = host.find(".", at)
            if dot < 0:
                return min(found)[1:] if found else (None, None)
            at = dot + 1

    def run(batches):
        strict, soft = words.value
        machine = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            machine.add_word(term, term)
        machine.make_automaton()
        lower = str.maketrans(UPPER, LOWER)
        wordly = set(LOWER + "0123456789")
        banned = set(strict)

        def hits(url: str):
            low, n, strict_hits, terms = url.translate(lower), len(url), 0, set()
            for last, term in machine.iter(low):
                start = last - len(term)
                if (start < 0 or low[start] not in wordly) and (last + 1 == n or low[last + 1] not in wordly):
                    if term in banned:
                        strict_hits += 1
                    if term in soft:
                        terms.add(term)
            return strict_hits, len(terms), float(sum(sorted(soft[t] for t in terms)))

        for urls, hosts, paths in batches:
            rows = []
            for url, host, path in zip(urls.to_pylist(), hosts.to_pylist(), paths.to_pylist()):
                rule, verdict = fitting(host, path)
                strict_hits, n_soft, weight = hits(url or "")
                if verdict is None:
                    verdict = "block" if strict_hits or weight >= soft_limit else "allow"
                rows.append({"rule": rule, "verdict": verdict, "strict_hits": strict_hits, "soft_terms": n_soft, "soft_weight": weight})
            yield pa.array(rows, pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int32()), ("soft_terms", pa.int32()),
                                            ("soft_weight", pa.float64())]))
    return run


def judge_urls(pages: DataFrame, url: str = "url", strict=STRICT, soft=None, soft_limit: float = SOFT_LIMIT, rules=RULES, vocabulary: DataFrame | None = None) -> DataFrame:
    """``pages`` without the columns named below, plus host, path, rule, verdict, strict_hits, soft_terms and soft_weight.

    The words are ``strict`` and ``soft``, or those of a table ``vocabulary`` (see ``read_vocabulary``); the built-in ones
    are an example. A rule decides if one fits. Else a URL is blocked on one strict word, or when its distinct soft words weigh
    ``soft_limit`` or more; since no weight is above 1, that takes several. A word counts only between characters
    other than a-z and 0-9 (or the ends), after A-Z are lower-cased. A null or empty URL, or one without ``://``, has
    an empty host and path and fits no rule; a null URL is allowed. Each row is judged alone: repeated rows get equal
    verdicts, an empty table stays empty, and any other columns are kept as they are.
    """
    if vocabulary is not None:
        strict, soft = read_vocabulary(vocabulary)
    soft = dict(SOFT if soft is None else soft)
    if any(w > 1 for w in soft.values()) or soft_limit <= 1:
        raise ValueError("a soft word weighs at most 1, and the limit is above 1")
    made = ["host", "path", "rule", "verdict", "strict_hits", "soft_terms", "soft_weight"]
    words = pages.sparkSession.sparkContext.broadcast((tuple(strict), soft))  # measured where it comes from a table
    function = F.arrow_udf(_typed(_judge(words, soft_limit, tuple(rules))), SCHEMA)
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in made]
    staged = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    staged = staged.withColumn("verdict", function(F.col(url), F.col("host"), F.col("path")))
    return staged.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in made], "host", "path", "verdict.*")


def _typed(run):
    from collections.abc import Iterator

    def batches(it: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(it)
    batches.__annotations__ = {"it": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return batches
