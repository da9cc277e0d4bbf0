"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 977}" for i in range(20_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, ids string, score string, block string, n_lines string, _doc string, host string"


def odd_documents(spark):
    """Rows as tuples are (doc_id, text, lang, source)."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, LONG, "en", "a"), (5, "one two three four five six", "en", None),
            (5, "one two three four five six", "en", None), (5, "another text under the same id as the one above it", "de", "a"), (None, "a text without an id, of some words", "en", "b"),
            (None, None, None, "b"), (6, "ÄÖÜ é \u2028 \U0001F600 \ud7ff", "de", "ß"), (7, "one two three four five six", "en", "a"), (8, "x", None, "b"), (9, "12 34 !!", "en", "b")]
    full = [(i, t, lang, s, None if t is None else len(t), "size", "ids", "score", "block", "lines", "doc", "host") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def no_documents(spark):
    return odd_documents(spark).where("false")


def copied_documents(seed: int = 5, n: int = 60):
    """(doc_id, text) with lines, passages and whole texts shared among them."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "ta") for b in ("n", "r", "s", "th", "x", "v", "m", "d")]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [line(rng.choice((2, 3, 12, 60))) for _ in range(12)]
    docs = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.4 else line(rng.randint(1, 30)) for _ in range(rng.randint(1, 9))]
        docs.append((i * 3, "\n".join(lines)))
    for i in range(n // 2):
        _, text = docs[rng.randrange(n)]
        parts = text.split(" ")
        for _ in range(rng.randint(0, 4)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        docs.append((i * 3 + 1, " ".join(parts)))
    return docs
