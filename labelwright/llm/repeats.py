"""Repeated passages by sparse suffixes: those at minimiser positions, grouped by content, with the passages that belong to them linked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.llm.common import buffers, long_lists, shingles, slices, text_key, word_hashes
from labelwright.session import cut_lineage

#: A passage is a repeat from this many words on.
MIN_WORDS = 50
#: Minimisers are taken over so many successive runs of ``GRAM`` words; one falls into every passage of GRAM + WINDOW - 1 words.
WINDOW = 24
GRAM = 8


def minimisers(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """For each window the position whose run of ``gram`` words has the least hash in it; the first of equal ones."""
    grams = shingles(words, gram)
    if len(grams) < window:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, window).argmin(1) + np.arange(len(grams) - window + 1)


def _anchors(min_words: int, window: int, gram: int):
    """Each anchor with the run of words behind it and the passages of ``min_words`` whose first window it is the minimiser of: ``n`` of them from ``pos`` on."""
    reach = min_words - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            ids, refs = batch.column(0), batch.column(1)
            for a, b in slices(offsets):
                words, first = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], False)
                rows, places, counts, groups = [], [], [], []
                for i in range(b - a):
                    own = words[first[i]:first[i + 1]]
                    if len(own) < min_words:
                        continue
                    at, start, n = np.unique(minimisers(own, gram, window)[:len(own) - min_words + 1], return_index=True, return_counts=True)
                    rows.append(np.full(len(at), a + i))
                    places.append(start)
                    counts.append(n)
                    groups.append(shingles(own, reach)[at])
                if rows:
                    row = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups).view(np.int64)), ids.take(row), refs.take(row), pa.array(np.concatenate(places).astype(np.int32)),
                                                      pa.array(np.concatenate(counts).astype(np.int32))], ["grp", "doc", "ref", "pos", "n"])
    return run


def _runs(min_words: int):
    """The hash of every passage of ``min_words`` of each kept anchor, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            wanted = batch.column(3)
            ends = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
            flat = wanted.flatten()
            groups, places, counts = (flat.field(k) for k in range(3))
            starts, sizes = places.to_numpy(), counts.to_numpy()
            for a, b in slices(offsets):
                words, first = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], False)
                parts = []
                for i in range(b - a):
                    hashes = shingles(words[first[i]:first[i + 1]], min_words).view(np.int64)
                    parts += [hashes[starts[k]:starts[k] + sizes[k]] for k in range(ends[a + i], ends[a + i + 1])]
                row = pa.array(np.repeat(np.arange(a, b), np.diff(ends[a:b + 1])))
                own = slice(int(ends[a]), int(ends[b]))
                yield pa.RecordBatch.from_arrays([groups[own], batch.column(0).take(row), batch.column(1).take(row), places[own], long_lists(parts, pa.int64())], ["grp", "doc", "ref", "pos", "runs"])
    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM,
                      partitions: int = 64) -> DataFrame:
    """``doc_id, first_word, n_words, other_doc_id, other_first_word``: maximal passages of ``min_words`` words or more that
    occur in an earlier document too (order: doc_id, then a hash of the text), with the earliest one that has their beginning.

    Words are compared as they are written; white space does not matter. Overlapping and touching matches of a document
    are one passage. Rows equal in doc_id and text are one document; rows without an id, and null and short texts, have
    no passages; repeats within one document are none. Other columns play no part.

    Suffixes start at minimiser positions, which depend on content alone, so copies have them at the same words. Those
    whose next words occur in one document are dropped before anything else is looked at. Every passage of ``min_words``
    belongs to one suffix, the minimiser of its first window, and is linked to the earliest document that has it. The
    passages of a suffix move together as a block: only the first of equal blocks is taken apart, the others follow it.
    """
    if min_words < window + gram - 1:
        raise ValueError("a passage must hold a whole window")
    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), text_key(F.col(doc_id), F.col(text)).alias("ref"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    anchors = base.mapInArrow(_anchors(min_words, window, gram), "grp long, doc long, ref long, pos int, n int")
    counted = anchors.withColumn("met", (F.min("ref").over(W.partitionBy("grp")) != F.max("ref").over(W.partitionBy("grp"))))
    kept = counted.where("met").select("grp", "doc", "ref", "pos", "n").distinct()
    wanted = kept.groupBy(F.col("doc").alias("d"), F.col("ref").alias("r")).agg(F.collect_list(F.struct("grp", "pos", "n")).alias("at"))
    joined = base.dropDuplicates(["doc", "ref"]).join(wanted, (F.col("doc") == F.col("d")) & (F.col("ref") == F.col("r"))).select("doc", "ref", "text", "at")
    blocks = cut_lineage(joined.mapInArrow(_runs(min_words), "grp long, doc long, ref long, pos int, runs array<long>").withColumn("block", F.xxhash64("runs")))
    heads = blocks.groupBy("grp", "block").agg(F.min(F.struct("doc", "ref", "pos")).alias("head"), F.first("runs").alias("runs"))
    taken = heads.select("grp", "block", "head", F.posexplode("runs").alias("i", "run"))
    place = F.struct(F.col("head.doc").alias("doc"), F.col("head.ref").alias("ref"), (F.col("head.pos") + F.col("i")).alias("pos"))
    holders = taken.groupBy("grp", "run").agg(F.min(place).alias("holder"), F.min("head.ref").alias("_a"), F.max("head.ref").alias("_z")).where("_a <> _z").drop("_a", "_z")
    # of a block the head's document has repeated what a still earlier one holds; later documents have all of it from there or from the head
    linked = taken.select("grp", "run", "block", "i", F.col("head.ref").alias("own")).join(holders, ["grp", "run"]).where("holder.ref <> own")
    linked = linked.groupBy("grp", "block").agg(F.min(F.struct("i", "holder")).alias("held_from"), F.max("i").alias("held_to"))
    later = F.struct("doc", "ref") > F.struct("head.doc", "head.ref")
    whole_from = F.when(F.col("held_from.i") == 0, F.col("held_from")).otherwise(F.struct(F.lit(0).alias("i"), F.col("head").alias("holder")))
    known = heads.select("grp", "block", "head", (F.size("runs") - 1).alias("whole_to")).join(linked, ["grp", "block"], "left")
    covered = blocks.select("grp", "block", "doc", "ref", "pos").join(known, ["grp", "block"]).select(
        "doc", "ref", "pos", F.when(later, whole_from).otherwise(F.col("held_from")).alias("a"), F.when(later, F.col("whole_to")).otherwise(F.col("held_to")).alias("z")).where("a is not null")
    # passages of one suffix begin within a window of each other and so overlap
    spans = covered.select("doc", "ref", (F.col("pos") + F.col("a.i")).alias("pos"), (F.col("z") - F.col("a.i") + min_words).alias("n"), F.col("a.holder.doc").alias("other"), F.col("a.holder.pos").alias("other_pos"))
    # passages: spans of a document that overlap or touch
    spans = spans.repartition(partitions, "doc", "ref")
    upto = W.partitionBy("doc", "ref").orderBy("pos", "n")
    starts = F.coalesce(F.col("pos") > F.max(F.col("pos") + F.col("n")).over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    numbered = spans.withColumn("_new", starts.cast("int")).withColumn("_g", F.sum("_new").over(upto.rowsBetween(W.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc", "ref", "_g").agg(F.min("pos").alias("first_word"), F.max(F.col("pos") + F.col("n")).alias("_end"), F.min(F.struct("pos", "other", "other_pos")).alias("_o"))
    return merged.select(F.col("doc").alias("doc_id"), "first_word", (F.col("_end") - F.col("first_word")).cast("int").alias("n_words"), F.col("_o.other").alias("other_doc_id"),
                         F.col("_o.other_pos").alias("other_first_word"))


def without_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of the text; texts without any stay as they are, others are joined by spaces.

    For ids that several rows share, a passage of one row is cut from all.
    """
    spans = passages.groupBy(F.col("doc_id").alias("_pd")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("_spans"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)
    left = F.array_join(F.filter(words, lambda w, i: ~F.exists("_spans", lambda s: (i >= s["first_word"]) & (i < s["first_word"] + s["n_words"]))), " ")
    joined = docs.join(spans, F.col(doc_id) == F.col("_pd"), "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
