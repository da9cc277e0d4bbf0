"""Near duplicates of vectors by lattice hashing: random projections decoded to points of the E8 lattice.

A table projects a unit vector to 16 random orthogonal directions, two blocks of eight, and decodes each block to its
nearest E8 point: the pair is the vector's home cell. The vector also visits the nearest neighbouring cells. Two
vectors meet where one is at home and the other at home or a visitor; what meets is compared by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.llm.common import fresh, join_frequent, mix
from labelwright.llm.components import components
from labelwright.session import cut_lineage

COSINE = 0.9
TABLES, VISITS, BLOCKS = 6, 8, 2
#: Lattice steps per unit of a projection.
SCALE = 4.0
#: Neighbours of a block's cell that are looked at for the nearest visits of the product.
NEAR = 7
GROUP_ROWS = 1024
#: Signs of random projections: vectors at 0.9 differ in 9.2 +- 2.8 of 64, unlike ones in 32 +- 4.
SKETCH_BITS, SKETCH_LIMIT = 64, 23
PAIRS = 1 << 16
SEED = 20_011

#: The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs.
ROOTS = np.array([v for v in product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2] + [tuple(x / 2 for x in v) for v in product((-1, 1), repeat=8) if np.prod(v) > 0], float)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round all, and where the sum is odd the worst rounded component the other way."""
    near = np.rint(x)
    off, rows = x - near, np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] < 0, -1.0, 1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of those with integer and with half-integer components."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _around(x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home and its ``NEAR`` nearest neighbours, with how much farther away their squares are."""
    more = 2 - 2 * (x - home) @ ROOTS.T
    near = np.argpartition(more, NEAR, axis=1)[:, :NEAR]
    return np.concatenate([home[:, None], home[:, None] + ROOTS[near]], 1), np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(more, near, 1)], 1)


def projections(width: int) -> np.ndarray:
    """One orthonormal set of directions a table; for shorter vectors the directions of a larger space, cut."""
    rng, n = np.random.default_rng(SEED), 8 * BLOCKS
    return np.stack([np.linalg.qr(rng.normal(size=(max(width, n), n)))[0][:width] for _ in range(TABLES)])


def cells(unit: np.ndarray, directions: np.ndarray, table: int) -> np.ndarray:
    """Hashes of each vector's cells in a table: home first, then the nearest visits."""
    # a unit vector of this many components has 1/sqrt of it in a direction; the scale is for 64
    x = unit @ directions[table] * (SCALE * np.sqrt(max(unit.shape[1], 8 * BLOCKS) / 64))
    rows = np.arange(len(x))[:, None]
    (a, da), (b, db) = (_around(x[:, s:s + 8], decode(x[:, s:s + 8])) for s in (0, 8))
    apart = (da[:, :, None] + db[:, None, :]).reshape(len(x), -1)
    apart[:, 0] = -1
    best = np.argpartition(apart, VISITS, axis=1)[:, :VISITS + 1]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(apart, best, 1), axis=1, kind="stable"), 1)
    points = np.concatenate([a[rows, best // (NEAR + 1)], b[rows, best % (NEAR + 1)]], 2)
    h = np.full(points.shape[:2], table + 1, np.uint64)
    for i in range(points.shape[2]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.rint(points[:, :, i] * 2).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _units(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(cell, id, home, signs)`` for every cell of a vector; vectors of a batch may differ in length."""
    known: dict[int, tuple] = {}
    for batch in batches:
        lengths = np.array([len(x) // 8 for x in batch.column(1).to_pylist()])
        for width in np.unique(lengths).tolist():
            picked = np.flatnonzero(lengths == width)
            part = batch.take(pa.array(picked))
            unit = _units(part.column(1))
            if width not in known:
                known[width] = (projections(width), np.random.default_rng(SEED + 1).normal(size=(width, SKETCH_BITS)))
            directions, planes = known[width]
            signs = np.packbits(unit @ planes >= 0, axis=1).view(np.uint64).ravel().view(np.int64)
            for table in range(TABLES):
                h = cells(unit, directions, table) ^ width
                for a in range(0, len(h), 2000):
                    z, n = h[a:a + 2000], len(h[a:a + 2000])
                    times = lambda c: np.repeat(c[a:a + 2000], VISITS + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(z.ravel()), pa.array(times(part.column(0).to_numpy())), pa.array(np.tile(np.arange(VISITS + 1) == 0, n)), pa.array(times(signs)),
                                                      pa.array(np.full(z.size, table), pa.int8())], ["cell", "id", "home", "signs", "table"])


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Tables of whole groups of equal first column, their starts, and whether the first goes on from the table before:
    a group beyond ``limit`` comes in parts."""
    held: list[pa.RecordBatch] = []
    rows, cut = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        key = pa.Table.from_batches(held).column(0).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        end = rows if limit and rows - starts[-1] > limit else int(starts[-1])
        if end:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, end), np.append(starts[starts < end], end), cut == key[0]
            cut = key[-1] if end == rows else None
            held, rows = whole.slice(end).to_batches(), rows - end
    if rows:
        whole = pa.Table.from_batches(held).combine_chunks()
        key = whole.column(0).to_numpy()
        yield whole, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [rows]]), cut == key[0]


def _pairs(starts: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of each home row with every other row of its group (homes once), in blocks of bounded size."""
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    owners = np.flatnonzero(home)
    sizes = np.diff(starts)[group[owners]]
    ends = np.cumsum(sizes)
    a = 0
    while a < len(owners):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        left = np.repeat(owners[a:b], sizes[a:b])
        first = np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
        right = np.arange(len(left)) - first + np.repeat(starts[group[owners[a:b]]], sizes[a:b])
        fine = (left != right) & (~home[right] | (left < right))
        yield left[fine], right[fine]
        a = b


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that their signs don't rule out with all others of their cell. A cell of very many rows passes whole."""
    for part, starts, goes_on in _groups(batches, 4 * GROUP_ROWS):
        home, signs = part.column("home").to_numpy(), part.column("signs").to_numpy().view(np.uint64)
        may = np.zeros(part.num_rows, bool)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 4 * GROUP_ROWS or (goes_on and a == 0):
                may[a:b] = True
        for left, right in _pairs(starts, home & ~may):
            near = np.bitwise_count(signs[left] ^ signs[right]) <= SKETCH_LIMIT
            may[left[near]] = may[right[near]] = True
        for batch in part.filter(pa.array(may)).select(["cell", "id", "home", "table"]).to_batches():
            yield batch


def _meeting(unit: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], directions: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Table and cell in which each pair meets first, among tables up to ``upto``."""
    rows, flat = np.unique(np.concatenate(pairs), return_inverse=True)
    left, right = flat[:len(pairs[0])], flat[len(pairs[0]):]
    where, cell = np.full(len(left), upto + 1), np.zeros(len(left), np.int64)
    for table in range(upto + 1):
        own = cells(unit[rows], directions, table) ^ unit.shape[1]
        open_ = np.flatnonzero(where > upto)
        a, b = own[left[open_]], own[right[open_]]
        at_a, at_b = (a[:, :1] == b).any(1), (b[:, :1] == a).any(1)
        met = at_a | at_b
        found = np.where(at_a & at_b, np.minimum(a[:, 0], b[:, 0]), np.where(at_a, a[:, 0], b[:, 0]))
        where[open_[met]], cell[open_[met]] = table, found[met]
    return where, cell


class Forest:
    """Of the links it is given, those that already connect all that they connect."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                self.parent[ra] = rb
                self.links.append((a, b))


def _compare(least: float):
    """Per block: how many rows each vector is linked with that it meets here first, and links that span the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for part, starts, _ in _groups(batches):
            ids, copies, cell, table, side = (part.column(c).to_numpy() for c in ("id", "copies", "cell", "table", "side"))
            home = part.column("home").to_numpy()
            lengths = np.array([len(x) // 8 for x in part.column("unit").to_pylist()])
            linked: dict[int, int] = {}
            forest = Forest()
            for width in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == width)
                unit = _units(part.column("unit").take(pa.array(mine)))
                if width not in known:
                    known[width] = projections(width)
                own_starts = np.searchsorted(mine, starts)
                own_starts = own_starts[np.concatenate([[True], np.diff(own_starts) > 0])]
                held = home[mine]
                for a, b in _pairs(own_starts, held):
                    between = side[mine[a]] != side[mine[b]]
                    fine = (between | (side[mine[a]] == 0)) & (cell[mine[a]] == cell[mine[b]])
                    a, b = a[fine], b[fine]
                    near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
                    a, b = a[near], b[near]
                    for t in np.unique(table[mine[a]]).tolist():
                        here = table[mine[a]] == t
                        x, y = a[here], b[here]
                        where, first = _meeting(unit, (x, y), known[width], t)
                        counts = (where == t) & (first == cell[mine[x]])
                        forest.add(ids[mine[x[counts]]], ids[mine[y[counts]]])
                        for p, q in ((x, y), (y, x)):
                            who, at = np.unique(ids[mine[p[counts]]], return_inverse=True)
                            for i, n in zip(who.tolist(), np.bincount(at, weights=copies[mine[q[counts]]], minlength=len(who)).tolist()):
                                linked[i] = linked.get(i, 0) + int(n)
            a = [e[0] for e in forest.links] + list(linked)
            b = [e[1] for e in forest.links] + [None] * len(linked)
            n = [0] * len(forest.links) + list(linked.values())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])
    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """Cells to blocks: one up to ``GROUP_ROWS`` rows is a block (side 0); a larger one is dealt to cuts, and every two
    cuts are a block (sides 1 and 2) as is each cut (side 0). So no task holds more, and no pair is lost."""
    counted = rows.groupBy("cell").agg(F.count("*").alias("_n"), F.count_if("home").alias("_h")).where("_n > 1 and _h > 0")
    sized = join_frequent(rows, counted, ["cell"], "_n")
    sized = sized.withColumn("cuts", F.ceil(F.col("_n") / GROUP_ROWS).cast("int")).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    low, high = F.least("cut", "other"), F.greatest("cut", "other")
    side = F.when(F.col("cut") == F.col("other"), 0).when(F.col("cut") < F.col("other"), 1).otherwise(2)
    return sized.withColumn("other", others).select(F.xxhash64("cell", low, high).alias("block"), "cell", "id", "home", "table", side.cast("byte").alias("side"))


def _classes(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, unit)``: every row; the unit vector as bytes, or null where the vector can't link."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0) & F.col(vec_id).isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if not v.is_valid else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if x is not None:
                    x = x / np.abs(x).max()
                    x = x / np.sqrt(x @ x)
                out.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])

    held: Column = F.when(usable, F.col(vector)).cast("array<double>")
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), held.alias("v")).mapInArrow(run, "vec_id long, unit binary")


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Rows are linked when they meet in a cell and their cosine, in double precision, is ``least`` or more (meant for 0.9
    and above: the cells are made for it). Vectors that are null, zero, empty or hold null or non-finite components
    link with nothing and are their own component, as are vectors of another length; a null id has a null component,
    links with nothing and is not kept. Rows of one id are linked through it in components, not in ``n_links``, which
    counts rows linked by cosine. An empty table gives an empty result; other columns play no part.

    1. Equal vectors are one class with its smallest id and number of rows. 2. Every class is at home in one cell of
    each table and visits the nearest ones; there its signs rule out most company. 3. Cells are cut to blocks of
    bounded size, only for them vectors are moved, and each linked pair counts in the cell where it meets first. 4. A
    block gives a count for each vector and links that span what is linked, never all pairs.
    """
    rows = cut_lineage(_classes(vectors, vec_id, vector).withColumn("k1", F.xxhash64("unit")).withColumn("k2", F.xxhash64(F.lit(1), "unit")))
    usable = rows.where("unit is not null")
    classes = cut_lineage(usable.groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("unit").alias("unit")).withColumn("id", F.monotonically_increasing_id()))
    light = classes.select("id", "unit").mapInArrow(_light, "cell long, id long, home boolean, signs long, table byte")
    likely = cut_lineage(light.repartition("cell").sortWithinPartitions("cell").mapInArrow(_likely, "cell long, id long, home boolean, table byte"))
    placed = _blocks(likely).join(classes.select("id", "copies", "unit"), "id").select("block", "id", "copies", "cell", "table", "side", "home", "unit")
    found = cut_lineage(placed.repartition("block").sortWithinPartitions("block").mapInArrow(_compare(least), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    nodes = classes.select("id", "low", "k1", "k2", "copies")
    # a class is named by its smallest id; where ids repeat, classes that share one are linked through it
    edges = found.where("b is not null").select("a", "b")
    named = edges.join(nodes.select(F.col("id").alias("a"), F.col("low").alias("x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("low").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    own = usable.join(nodes, ["k1", "k2"])
    several = own.where("low <> vec_id").select(F.col("vec_id").alias("a"), F.col("low").alias("b"))
    linked = components(named.unionByName(several))
    joined = own.join(counts, "id", "left").join(linked, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    met = joined.select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return met.unionByName(alone)


def drop_near_duplicates(vectors: DataFrame, links: DataFrame, vec_id: str = "vec_id") -> DataFrame:
    """The rows of ``vectors`` whose id is kept; all columns stay."""
    key = fresh(vectors, "kept_id")
    return vectors.join(links.where("kept").select(F.col("vec_id").alias(key)).distinct(), F.col(vec_id) == F.col(key), "left_semi")
