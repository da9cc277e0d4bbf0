"""Helpers the operators share: free column names, word hashes over Arrow buffers, shared tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is cut into words at ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text a worker hashes at once; hashing takes some forty times as much memory, whatever the batch.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Keys with more than one in so many rows are frequent; there are at most as many of them.
FREQUENT_SHARES = 500


def join_frequent(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key and in ``n`` how many of ``rows`` have it.

    Frequent keys are looked up by broadcast, at most ``FREQUENT_SHARES`` rows, and only the others are shuffled: no
    task takes all rows of one. ``rows`` is read three times and ought to be written down.
    """
    often = F.col(n) > rows.count() / FREQUENT_SHARES
    frequent = F.broadcast(table.where(often))
    return rows.join(frequent, keys).unionByName(rows.join(frequent, keys, "left_anti").join(table.where(~often), keys))


def text_key(doc_id: Column, text: Column) -> Column:
    """Tells rows of one doc_id apart: rows equal in doc_id and text are copies of one document."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo; a null doc_id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    filled = pc.fill_null(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).cast(pa.large_binary()), b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = np.frombuffer(filled.buffers()[2], np.uint8) if len(filled) and filled.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text comes alone."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(end, rows)
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and where each row's words begin (one entry more than rows). ``fold`` lower-cases A-Z.

    A word's hash is a difference of prefix hashes, so the work is a few passes over the bytes.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[offsets < n]] = False
    after[offsets[offsets > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers_upto(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * power[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start]), np.searchsorted(start, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _PLACE[0]
    for j in range(1, width):
        total = total + words[j:j + n] * _PLACE[j % 64]
    return mix(total + np.uint64(width))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets):
        words, first = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], True)
        for i in range(b - a):
            own = words[first[i]:first[i + 1]]
            yield np.unique(shingles(own, min(width, len(own)))) if len(own) else np.zeros(0, np.uint64)


def long_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
