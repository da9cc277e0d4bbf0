"""Exact n-gram Jaccard join: T-occurrence search over inverted lists, short ones merged and long ones probed (DivideSkip)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.llm.common import fresh, shingle_sets, text_key
from labelwright.llm.components import components
from labelwright.session import cut_lineage

#: Shingles are counted in so many cells, only to order them from rare to frequent; any order gives the same links.
CELLS = 1 << 20
_PART = 1 << 16
BLOCK_DOCS = 1024
#: Shingles of one side of a block, but for a single larger document: documents of any length give blocks of like size.
BLOCK_SHINGLES = 1 << 20
#: Bytes of shingle sets handed on at once.
SET_BYTES = 1 << 22
MU = 0.0085
#: A list of short lists in which a class has so many classes of matching size before it is chained instead of paired.
CROWDED = 16
#: Counts for a pair more than any set has shingles.
ALL = 1 << 40
SIGNED = "doc_id long, key long, n int, s1 long, s2 long, sketch binary, part int, counts binary"

SIGNED_NAMES = ["doc_id", "key", "n", "s1", "s2", "sketch", "part", "counts"]


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _digest(own: np.ndarray) -> int:
    return xxhash.xxh3_128_intdigest(own.tobytes())


def sketch(own: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 cells: two sets have no more in common than the sum of the smaller counts.
    Empty if a count does not fit a byte; such a set is never ruled out."""
    counts = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = np.zeros(CELLS, np.uint32), []
        for batch in batches:
            n, s1, s2, sketches = [], [], [], []
            for own in shingle_sets(batch.column(2), width):
                held.append(_cell(own))
                if len(held) >= 1000 or len(own) > CELLS:
                    seen += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                    held = []
                digest = _digest(own)
                n.append(len(own))
                sketches.append(sketch(own))
                s1.append(digest >> 64)
                s2.append(digest & (1 << 64) - 1)
            none = pa.nulls(len(n), pa.int32())
            signs = [pa.array(np.array(s, np.uint64).view(np.int64)) for s in (s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), *signs, pa.array(sketches, pa.binary()), none, pa.nulls(len(n), pa.binary())], SIGNED_NAMES)
        if held:
            seen += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
        parts = [p for p in range(CELLS // _PART) if seen[p * _PART:(p + 1) * _PART].any()]
        packed = [zlib.compress(seen[p * _PART:(p + 1) * _PART].tobytes(), 1) for p in parts]
        blank = [pa.nulls(len(parts), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], SIGNED_NAMES)
    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
            sums[part] = sums[part] + counts if part in sums else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "counts"])


def _ranks(signed: DataFrame) -> np.ndarray:
    """Count per cell over all documents; ``CELLS`` numbers reach the driver."""
    rows = signed.where("part is not null").select("part", "counts").repartition(CELLS // _PART, "part").mapInArrow(_add_parts, "part int, counts binary").collect()
    seen = np.zeros(CELLS, np.uint64)
    for row in rows:
        seen[row["part"] * _PART:(row["part"] + 1) * _PART] += np.frombuffer(row["counts"], np.uint64)
    return np.minimum(seen, (1 << 32) - 1).astype(np.uint32)


def _short_lists(width: int, percent: int, seen):
    """The n - T + 1 rarest shingles of each set: two sets of n and T shingles or more in common meet in one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = seen.value
        for batch in batches:
            tokens, sizes, marks = [], [], []
            for own in shingle_sets(batch.column(2), width):
                keep = len(own) + (-percent * len(own)) // 100 + 1 if len(own) else 0
                rare = own[np.lexsort((own, order[_cell(own)]))[:keep]] if len(own) else own
                tokens.append(rare)
                sizes.append(len(own))
                marks.append(_digest(own) >> 64)
            times = [len(t) for t in tokens]
            column = lambda values, kind: np.repeat(np.array(values, kind), times)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            for a in range(0, len(flat), 200_000):
                z = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(flat[z].view(np.int64)), pa.array(column(ids, np.int64)[z]), pa.array(column(sizes, np.int32)[z]),
                                                  pa.array(column(marks, np.uint64)[z].view(np.int64))], ["token", "id", "n", "mark"])
    return run


def divide_skip(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among sorted shingle sets, without those that earlier ones already imply: together they reach what all do.

    Sets are queried from small to large against the smaller ones. A partner needs T common shingles; the L longest of
    the query's inverted lists are put aside, the others merged, and only those met T - L times are probed for in the
    rest by binary search.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    every = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.uint64)
    by_token = np.argsort(every, kind="stable")
    every = every[by_token]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    ends = np.append(np.flatnonzero(new), len(every))
    times = np.diff(ends)
    del every
    place = np.empty(len(new), np.int32)
    place[by_token] = np.cumsum(new, dtype=np.int32) - 1
    lists = np.repeat(np.arange(len(order), dtype=np.int32), size)[by_token]
    del by_token, new
    parent = list(range(len(order)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, at = [], np.concatenate([[0], np.cumsum(size)])
    for q in range(1, len(order)):
        first = int(np.searchsorted(size, -(-percent * size[q] // 100)))
        if first >= q:
            continue
        need = -(-percent * (size[q] + size[first]) // (100 + percent))
        mine = place[at[q]:at[q + 1]]
        mine = mine[times[mine] > 1]
        if len(mine) < need:
            continue
        mine = mine[np.argsort(times[mine], kind="stable")]
        aside = int(min(need - 1, need / (MU * np.log2(times[mine[-1]] + 1) + 1)))
        short, long = mine[:len(mine) - aside], mine[len(mine) - aside:]
        merged = np.concatenate([lists[ends[t]:ends[t + 1]] for t in short])
        merged = merged[(merged >= first) & (merged < q)]
        met = np.bincount(merged - first, minlength=q - first)
        for c in np.flatnonzero(met >= need - aside):
            other = int(c) + first
            wanted = -(-percent * (size[q] + size[other]) // (100 + percent))
            if met[c] + aside < wanted or root(q) == root(other):
                continue
            held = place[at[other]:at[other + 1]]
            spot = np.minimum(np.searchsorted(held, long), len(held) - 1)
            if met[c] + (held[spot] == long).sum() >= wanted:
                parent[root(q)] = root(other)
                links.append((order[q], order[other]))
    return links


def _rule_out(percent: int):
    """Documents of a block that may link with another, as far as sizes and sketches tell."""
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("n")
        n = block.column("n").to_numpy().astype(np.int64)
        known = np.array([len(x) > 0 for x in block.column("sketch").to_pylist()])
        cells = np.frombuffer(b"".join(x or b"\xff" * 256 for x in block.column("sketch").to_pylist()), np.uint8).reshape(-1, 256)
        may = np.zeros(len(n), bool)
        for q in range(1, len(n)):
            first = int(np.searchsorted(n, -(-percent * n[q] // 100)))
            if first < q:
                common = np.minimum(cells[first:q], cells[q]).sum(1, dtype=np.int64)
                fine = (common * (100 + percent) >= percent * (n[first:q] + n[q])) | ~known[first:q] | (not known[q])
                may[first:q] |= fine
                may[q] |= fine.any()
        return block.filter(pa.array(may)).select(["node", "component", "n"])
    return run


def _link_block(percent: int):
    def run(block: pa.Table) -> pa.Table:
        held = {i: np.frombuffer(s.as_buffer(), np.uint64) for i, s in zip(block.column("id").to_pylist(), block.column("shingles"))}
        ids = list(held)
        links = divide_skip(list(held.values()), percent)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})
    return run


def _sets(width: int):
    """The shingle set of each class in each of its blocks, from the texts of its document that have this very set."""
    def part(batch: pa.RecordBatch, rows: list[int], sets: list[bytes]) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sets, pa.binary())], ["id", "block", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            rows, sets, size = [], [], 0
            for i, own in enumerate(shingle_sets(batch.column(2), width)):
                if _digest(own) >> 64 == wanted[i]:
                    rows.append(i)
                    sets.append(own.tobytes())
                    size += own.nbytes
                if size >= SET_BYTES:
                    yield part(batch, rows, sets)
                    rows, sets, size = [], [], 0
            yield part(batch, rows, sets)
    return run


def _blocks(nodes: DataFrame, percent: int, block_docs: int, block_shingles: int | None = None) -> DataFrame:
    """``(node, component, n)`` to ``(node, block)``: small groups are packed together; a group above ``block_docs`` (or
    ``block_shingles``, where sets travel and not sketches) is cut by size, and each two cuts whose sizes can match form a block."""
    by_size = W.partitionBy("component").orderBy("n", "node")
    number = F.floor((F.row_number().over(by_size) - 1) / block_docs)
    packs = max(1, nodes.count() // block_docs)
    if block_shingles:
        number += F.floor((F.sum("n").over(by_size.rowsBetween(W.unboundedPreceding, 0)) - 1) / block_shingles)
        packs = max(packs, (nodes.agg(F.sum("n")).first()[0] or 0) // block_shingles)
    cut = nodes.withColumn("cut", number.cast("int"))
    cuts = cut.groupBy("component", "cut").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("docs"))
    group = cuts.groupBy("component").agg(F.count("*").alias("cuts"))
    small = cut.join(group.where("cuts = 1"), "component").select("node", F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), F.lit(packs)).cast("string")).alias("block"))
    large = cuts.join(group.where("cuts > 1"), "component").drop("cuts", "docs")
    other = large.select("component", F.col("cut").alias("cut2"), F.col("low").alias("low2"))
    met = large.join(other, "component").where((F.col("cut") <= F.col("cut2")) & (F.lit(100) * F.col("high") >= F.lit(percent) * F.col("low2")))
    named = met.select("component", "cut", "cut2", F.concat_ws(":", "component", "cut", "cut2").alias("block"))
    sides = named.select("component", "cut", "block").unionByName(named.select("component", F.col("cut2").alias("cut"), "block")).distinct()
    return small.unionByName(cut.join(sides, ["component", "cut"]).select("node", "block"))


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(doc_id), F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _node(rep: str, mark: str) -> Column:
    """Stands for a class while groups are formed; classes of one value would only be in one group."""
    return F.xxhash64(F.col(rep).cast("long"), F.col(mark))


def _edges(short: DataFrame, percent: int) -> DataFrame:
    """Postings ``(token, id, n, mark)`` to edges ``(a, b)`` of ``_node``; what they reach holds every link.

    In a list ordered by size a class pairs with those before it whose sizes match. Two sets share so many shingles at most
    as were met in short lists, and those behind the end of the one that ends first; a pair met too seldom goes. A list in
    which a class has ``CROWDED`` such classes before it is chained, neighbour to neighbour, and its edges all stay.
    """
    by_size = W.partitionBy("token").orderBy("n", "mark", "id")
    fits = lambda small, large: F.lit(100) * small >= F.lit(percent) * large
    n = F.col("n").cast("long")
    sized = short.withColumn("n", n).withColumn("_last", F.lag(F.struct("n", "mark")).over(by_size))
    once = sized.where(F.col("_last").isNull() | (F.col("_last") != F.struct("n", "mark"))).drop("_last")
    beside = once.withColumn("_p", F.lag("n").over(by_size)).withColumn("_f", F.lead("n").over(by_size))
    met = beside.where(fits(F.col("_p"), F.col("n")) | fits(F.col("n"), F.col("_f"))).drop("_p", "_f")
    before = F.collect_list(F.struct("n", "mark", "id")).over(by_size.rowsBetween(1 - CROWDED, -1))
    far = F.coalesce(fits(F.lag("n", CROWDED).over(by_size), F.col("n")), F.lit(False))
    listed = met.withColumn("_before", before).withColumn("_far", far).withColumn("_crowded", F.max("_far").over(W.partitionBy("token")))
    partners = F.filter(F.when(F.col("_crowded"), F.slice("_before", -1, 1)).otherwise(F.col("_before")), lambda s: fits(s["n"], F.col("n")))
    pairs = listed.select(F.explode(partners).alias("p"), "n", "mark", "id", F.when(F.col("_crowded"), F.lit(ALL)).otherwise(F.lit(1)).alias("times"))
    ends = [_node("p.id", "p.mark").alias("a"), _node("id", "mark").alias("b"), F.col("p.n").alias("a_n"), F.col("n").alias("b_n")]
    times = pairs.groupBy(*ends).agg(F.sum("times").alias("times"))
    common = F.ceil(F.lit(percent) * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent))
    behind = F.ceil(F.lit(percent) * F.col("b_n") / F.lit(100)) - 1
    return times.where(F.col("times") + behind >= common).select("a", "b")


def _classes(docs: DataFrame, doc_id: str, text: str, width: int, percent: int, block_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(doc_id, key, n, class)``, classes ``(class, rep, rep_key)`` with the first row of each, and links ``(a, b)``
    of classes that reach what all links do. A class is the rows of one shingle set; a row without words or id has none."""
    spark = docs.sparkSession
    base = _base(docs, doc_id, text)
    signed = cut_lineage(base.mapInArrow(_sign(width), SIGNED))
    rows = signed.where("part is null").select("doc_id", "key", "n", "s1", "s2", "sketch")
    own = rows.where("n > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "key"))
    classes = own.groupBy("n", "s1", "s2").agg(first.alias("rep"), F.max("sketch").alias("sketch"))
    classes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("class"), "n", "s1", "s2", "sketch", F.col("rep.doc_id").alias("rep"), F.col("rep.key").alias("rep_key")))
    held = rows.join(classes.select("n", "s1", "s2", "class"), ["n", "s1", "s2"], "left")
    held = cut_lineage(held.select("doc_id", "key", "n", "s1", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class")))
    seen = spark.sparkContext.broadcast(_ranks(signed))
    short = base.where("doc_id is not null").mapInArrow(_short_lists(width, percent, seen), "token long, id long, n int, mark long")
    groups = components(_edges(short, percent))
    named = classes.select("class", "n", "sketch", _node("rep", "s1").alias("_class"))
    grouped = cut_lineage(groups.join(named, F.col("node") == F.col("_class")).select(F.col("class").alias("node"), "component", "n", "sketch"))
    drawn = grouped.join(_blocks(grouped.select("node", "component", "n"), percent, block_docs).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    likely = drawn.select("block", "node", "component", "n", "sketch").groupBy("block").applyInArrow(_rule_out(percent), "node long, component long, n int")
    nodes = cut_lineage(likely.distinct())
    blocks = _blocks(nodes, percent, block_docs, BLOCK_SHINGLES).join(classes.select(F.col("class").alias("node"), "rep", "s1"), "node")
    met = base.join(blocks, base.doc_id == blocks.rep).select("node", "block", "text", "s1")
    found = met.mapInArrow(_sets(width), "id long, block string, shingles binary").groupBy("block").applyInArrow(_link_block(percent), "a long, b long")
    return held, classes.select("class", "rep", "rep_key"), cut_lineage(found)


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the smallest doc_id that links reach.

    Two documents are linked when the Jaccard similarity of their sets of distinct ``width``-word shingles (A-Z
    lower-cased) is ``percent`` or more. A text of fewer words is one shingle; one without words, or null, has none and
    is linked with nothing. Rows of one doc_id are linked through it. A null doc_id has a null component and links
    nothing. An empty table gives an empty result; other columns play no part.

    1. Rows of equal sets are one class. 2. The rarest n - T + 1 shingles of each set are its short lists; any two sets
    that can link share one. 3. Classes of a list whose sizes can match are paired, and pairs met too seldom to link go; in
    long lists, ordered by size, neighbours are chained instead. Both form groups that contain every link. 4. Within a group, in blocks of bounded size, sketches rule out classes that
    can't link. 5. Blocks of the others are searched exactly; only for them are full sets made.
    """
    rows, classes, found = _classes(docs, doc_id, text, width, percent, block_docs)
    rep = lambda end: classes.select(F.col("class").alias(end), F.col("rep").alias(f"{end}_rep"))
    links = found.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    copies = rows.join(classes, "class").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = components(links.unionByName(copies))
    return rows.join(linked, rows.doc_id == linked.node, "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of texts that links reach the one of the smallest id (of several
    under that id the one with the smallest key), in one row. Rows whose id is null and texts without words stay as they
    are. Unlike texts under one id are documents of their own and both stay."""
    rows, classes, found = _classes(docs, doc_id, text, width, percent, block_docs)
    linked = components(found)
    grouped = classes.join(linked, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("component", "class"))
    kept = grouped.groupBy("group").agg(F.min(F.struct("rep", "rep_key")).alias("k"))
    bare = rows.where("class is null").select("doc_id", "key").distinct().withColumn("one", F.lit(False))
    stay = kept.select(F.col("k.rep").alias("doc_id"), F.col("k.rep_key").alias("key"), F.lit(True).alias("one")).unionByName(bare)
    i, k, one, place = (fresh(docs, x) for x in ("kept_id", "kept_key", "kept_one", "kept_row"))
    stay = stay.select(F.col("doc_id").alias(i), F.col("key").alias(k), F.col("one").alias(one))
    joined = docs.join(stay, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (text_key(F.col(doc_id), F.col(text)) == F.col(k)))
    first = F.row_number().over(W.partitionBy(i, k).orderBy(F.col(text)))
    numbered = joined.withColumn(place, first).where(~F.col(one) | (F.col(place) == 1))
    return numbered.select(*[F.col(f"`{x}`") for x in docs.columns])
