"""Product codes of vectors: every part gets its nearest codebook entry, found by pivots (LAESA).

The distances of a part to a few fixed pivots are computed once and kept with the vector. In each round the pivots'
distances to the codebook's entries give lower bounds by the triangle inequality; entries are tried by rising bound, and
only while their bound does not exceed the best distance found, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelwright.llm.common import fresh
from labelwright.llm.topk import whole_components
from labelwright.session import cut_lineage

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 3
#: Rows of one step, so that its bounds stay a few MB.
STEP = 4096
#: Pivot distances are kept as 32-bit floats; bounds give way by more than their rounding.
SLACK = 1e-6
#: Components beyond this are an error: sums of squares must fit a long.
WIDEST = 1 << 27


def pivots_of(book: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Entries far from one another: the first, then always the one with the largest sum of distances to those taken."""
    taken = [0] if len(book) else []
    while len(taken) < min(n, len(book)):
        apart = np.sqrt(((book[:, None] - book[taken][None]) ** 2).sum(-1).astype(float)).sum(1)
        apart[taken] = -1
        taken.append(int(apart.argmax()))
    return book[taken]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(-1).astype(float))


def nearest(points: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each point's nearest entry, ties to the lower index, and how many were evaluated."""
    between = distances(book, pivots)
    bound = np.zeros((len(points), len(book)))
    for p in range(len(pivots)):
        x, e = to_pivots[:, p, None], between[None, :, p]
        np.maximum(bound, np.abs(x - e) - SLACK * (x + e), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    at, best = np.full(len(points), len(book)), np.full(len(points), np.iinfo(np.int64).max)
    active, tried = np.arange(len(points)), 0
    for step in range(len(book)):
        entry = order[active, step]
        near = bound[active, entry] ** 2 * (1 - 1e-9) <= best[active]
        active, entry = active[near], entry[near]
        if not len(active):
            break
        tried += len(active)
        found = ((points[active] - book[entry]) ** 2).sum(1)
        better = (found < best[active]) | ((found == best[active]) & (entry < at[active]))
        best[active[better]], at[active[better]] = found[better], entry[better]
    return at, best, tried


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _prepare(pivots: list[np.ndarray], width: int, names: list[str]):
    """Components as 64-bit integers, pivot distances as 32-bit floats, both as bytes."""
    n = len(names) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column(n).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if np.abs(points).max(initial=0) > WIDEST:
                raise ValueError(f"a scaled component is beyond {WIDEST}")
            cut = np.split(points, len(pivots), axis=1)
            far = np.concatenate([distances(c, p) for c, p in zip(cut, pivots)], axis=1).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([r.tobytes() for r in points.astype(np.int64)], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary())], names)
    return run


def _assign(points: np.ndarray, far: np.ndarray, pivots: list[np.ndarray], books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each part in turn: its components, indices and squared distances."""
    width, n = points.shape[1] // len(books), len(pivots[0])
    for j, book in enumerate(books):
        mine = points[:, j * width:(j + 1) * width]
        at, best, _ = nearest(mine, far[:, j * n:(j + 1) * n].astype(float), pivots[j], book)
        yield j, mine, at, best


def _steps(batches: Iterator[pa.RecordBatch], first: int, width: int, held: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            part = batch.slice(a, STEP)
            yield part, _matrix(part.column(first), np.int64, width), _matrix(part.column(first + 1), np.float32, held)


def _sums(pivots: list[np.ndarray], books: list[np.ndarray], width: int):
    """Per task: count and component sums of each entry's parts, one row a component."""
    k, w = len(books[0]), width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((len(books), k), np.int64), np.zeros((len(books), k, w), np.int64)
        for _, points, far in _steps(batches, 0, width, len(books) * len(pivots[0])):
            for j, mine, at, _ in _assign(points, far, pivots, books):
                count[j] += np.bincount(at, minlength=k)
                np.add.at(total[j], at, mine)
        j, e, i = (x.ravel() for x in np.indices(total.shape))
        used = count[j, e] > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used], t) for x, t in ((j, pa.int32()), (e, pa.int32()), (i, pa.int32()), (count[j, e], pa.int64()), (total.ravel(), pa.int64()))],
                                         ["part", "entry", "place", "n", "total"])
    return run


def _codes(pivots: list[np.ndarray], books: list[np.ndarray], width: int, names: list[str]):
    n = len(names) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, points, far in _steps(batches, n, width, len(books) * len(pivots[0])):
            code, error = np.zeros((len(points), len(books)), np.uint8), np.zeros(len(points), np.int64)
            for j, _, at, best in _assign(points, far, pivots, books):
                code[:, j] = at
                error += best
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names)
    return run


@dataclass
class Coded:
    """Every kept row with ``code`` (a byte for each part) and ``error`` (long), and the final codebooks."""

    rows: DataFrame
    code: str
    error: str
    books: list[np.ndarray]

    def digest(self) -> str:
        flat = [str(int(x)) for book in self.books for entry in book for x in entry]
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def code_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, n_pivots: int = PIVOTS, scale: float = 256.0) -> Coded:
    """Codes of all vectors by codebooks that begin with the ``entries`` smallest ids (at most 256) and are moved to the
    floor of their parts' mean ``rounds`` times.

    Rows whose vector is null or holds null or non-finite components go, also those of another length than the first
    kept vector's, and all if that is not a positive multiple of ``parts``. Of a repeated id the smallest by components
    begins an entry; every row is coded and counts for the means. A null id never begins an entry; if all ids are null
    or nothing is kept, there are no rows and no codebooks. A scaled component beyond 2**27 is an error. The other
    columns stay, the vector itself goes. What reaches the driver is one row for each component of the codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    code, error = fresh(vectors, "code"), fresh(vectors, "error")
    kept = [c for c in vectors.columns if c != vector]
    v, far = fresh(vectors, "v"), fresh(vectors, "far")
    points = vectors.withColumn(v, whole_components(F.col(vector), scale)).where(F.col(v).isNotNull())
    ids = points.where(F.col(vec_id).isNotNull()).groupBy(F.col(vec_id).alias("i")).agg(F.min(v).alias("v"))
    begin = [r["v"] for r in ids.orderBy("i").limit(entries).collect()]
    width = len(begin[0]) if begin else 0
    if not width or width % parts:
        none = vectors.select(kept).where("false").withColumn(code, F.lit(None).cast("binary")).withColumn(error, F.lit(None).cast("long"))
        return Coded(none, code, error, [])
    if any(len(v) != width for v in begin):
        begin = [r["v"] for r in ids.where(F.size("v") == width).orderBy("i").limit(entries).collect()]
    books = np.split(np.array(begin, np.int64), parts, axis=1)
    pivots = [pivots_of(b, n_pivots) for b in books]
    held = StructType([f for f in vectors.schema if f.name in kept])
    names = [f"`{c}`" for c in kept]
    prepared = points.where(F.size(v) == width).select(*names, v).mapInArrow(_prepare(pivots, width, [*kept, v, far]), StructType(list(held)).add(v, "binary").add(far, "binary"))
    prepared = cut_lineage(prepared)
    for _ in range(rounds):
        sums = prepared.select(v, far).mapInArrow(_sums(pivots, books, width), "part int, entry int, place int, n long, total long")
        moved = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            moved[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        books = moved
    coded = prepared.mapInArrow(_codes(pivots, books, width, [*kept, code, error]), held.add(code, "binary").add(error, "long"))
    return Coded(coded, code, error, books)


def with_group_total(rows: DataFrame, key: str, value: str, out: str, shares: int = 1000) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of equal ``key``, nulls together. Keys with more than one in
    ``shares`` rows, at most ``shares`` of them, are looked up by broadcast; only the others are shuffled to their sums."""
    name, n = fresh(rows, "key"), fresh(rows, "n")
    total = rows.groupBy(F.col(key).alias(name)).agg(F.sum(value).alias(out), F.count("*").alias(n))
    often = F.col(n) > rows.count() / shares
    frequent = F.broadcast(total.where(often).drop(n))
    same: Column = F.col(key).eqNullSafe(F.col(name))
    first = rows.join(frequent, same).drop(name)
    rest = rows.join(frequent, same, "left_anti").join(total.where(~often).drop(n), same).drop(name)
    return first.unionByName(rest)
