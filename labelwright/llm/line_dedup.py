"""Repeated runs of lines by a suffix array over line ids, built by prefix doubling with expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions.text import let
from labelwright.llm.common import fresh, join_frequent, text_key
from labelwright.session import cut_lineage

#: A repeated run is deleted from this many letters and digits on; a line counts as one at least. Brackets, table rules
#: and the like are structure that documents share without being copies; several of them in a row are a run again.
MIN_LETTERS = 8
#: Lines of these alone are blank.
BLANK = " \t\r\x0b\x0c"
_HERE = ("doc", "key", "pos")


def _rank_within(classes: DataFrame, group: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``classes(group, order, n)`` plus ``before``: how many suffixes of the same group sort lower.

    Summed per bucket first (a coarse, order-keeping part of the order), so a group of any size is spread.
    """
    staged = classes.withColumn("_b", bucket)
    sums = staged.groupBy(*group, "_b").agg(F.sum("n").alias("_s"))
    earlier = W.partitionBy(*(group or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy(*group, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return staged.withColumn("_in", inside).join(starts, [*group, "_b"]).withColumn("before", F.col("_start") + F.col("_in")).drop("_b", "_in", "_start")


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, key, pos, line, h1, h2, letters`` per line that is not blank; pos counts those, line counts all."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x"))), lambda s: F.length(F.trim(s["x"], F.lit(BLANK))) > 0)
    base = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(doc_id), F.col(text)).alias("key"), F.posexplode(lines).alias("pos", "s"))
    return base.select("doc", "key", "pos", "s.line", F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(7), F.col("s.x")).alias("h2"), F.greatest(F.lit(1), F.length(F.regexp_replace("s.x", r"[^\p{L}\p{N}]+", ""))).alias("letters"))


def suffix_array(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS) -> tuple[DataFrame, int]:
    """Suffixes that begin with a repeated line, with their rank by the first 1, 2, 4 ... lines (``r0, r1, r2 ...``) and
    the lengths in lines of the shortest runs of ``min_letters`` that begin (``ahead``) and end (``back``) at them.

    A line that occurs once ends every repeated run, so only repeated lines are ranked. In round k suffixes of equal rank
    are told apart by the rank 2**k lines further on; those that share it with no other leave. Runs of ``min_letters``
    are at most so many lines long, which is all the depth that is needed; returns the number of rounds as well.
    """
    rows = line_table(docs, doc_id, text)
    classes = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ranked = _rank_within(classes, [], ["h1", "h2"], F.shiftright(F.col("h1"), 48)).withColumnRenamed("before", "r0").drop("n")
    sa = rows.join(ranked, ["h1", "h2"]).dropDuplicates(list(_HERE)).drop("h1", "h2")
    here = W.partitionBy("doc", "key").orderBy("pos")
    total = F.sum("letters").over(here.rowsBetween(W.unboundedPreceding, 0))
    sa = sa.withColumn("_to", total).withColumn("_from", F.col("_to") - F.col("letters"))
    ahead = F.collect_list(F.struct("pos", "_to")).over(here.rowsBetween(0, min_letters - 1))
    back = F.collect_list(F.struct("pos", "_from")).over(here.rowsBetween(-(min_letters - 1), 0))
    sa = sa.withColumn("_a", ahead).withColumn("_z", back)
    last = F.get(F.filter("_a", lambda s: s["_to"] >= F.col("_from") + min_letters), F.lit(0))["pos"]
    first = F.element_at(F.concat(F.array(F.lit(None).cast("struct<pos:int,_from:bigint>")), F.filter("_z", lambda s: s["_from"] <= F.col("_to") - min_letters)), -1)["pos"]
    sa = cut_lineage(sa.withColumn("ahead", last - F.col("pos") + 1).withColumn("back", F.col("pos") - first + 1).drop("_a", "_z", "_to", "_from"))
    longest = sa.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 1
    rounds = longest.bit_length() - 1
    for k in range(rounds):
        further = F.max(f"r{k}").over(here.rangeBetween(2 ** k, 2 ** k))
        paired = sa.withColumn("_next", further)
        pairs = paired.where(f"r{k} is not null and _next is not null").groupBy(f"r{k}", "_next").agg(F.count("*").alias("n")).where("n > 1")
        known = _rank_within(pairs, [f"r{k}"], ["_next"], F.shiftright(F.col("_next"), 16)).select(f"r{k}", "_next", (F.col(f"r{k}") + F.col("before")).alias(f"r{k + 1}"))
        sa = cut_lineage(paired.join(known, [f"r{k}", "_next"], "left").drop("_next"))
    return sa, longest


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS) -> DataFrame:
    """``doc, key, line``: the lines of later copies of repeated runs of ``min_letters`` or more.

    Two runs of n lines are equal when the suffixes at them have equal ranks at depth 2**k, and so have those 2**k lines
    before their ends (2**k <= n < 2**(k+1)): they lie in one interval of the suffix array whose common prefix is n
    lines or more. Every line of a repeated run lies in a shortest run of ``min_letters`` that begins or ends within it.
    """
    sa, longest = suffix_array(docs, doc_id, text, min_letters)
    here = W.partitionBy("doc", "key").orderBy("pos")
    at = lambda k, o: F.max(f"r{k}").over(here.rangeBetween(o, o))
    runs = []
    for column, start in (("ahead", lambda n: 0), ("back", lambda n: 1 - n)):
        parts = [F.when(F.col(column) == n, F.struct(F.lit(n).alias("n"), (F.col("pos") + start(n)).alias("pos"), at(n.bit_length() - 1, start(n)).alias("r"),
                                                     at(n.bit_length() - 1, start(n) + n - 2 ** (n.bit_length() - 1)).alias("q"))) for n in range(1, longest + 1)]
        runs.append(F.coalesce(*parts))
    windowed = sa.withColumn("_ahead", runs[0]).withColumn("_back", runs[1])
    found = windowed.select("doc", "key", F.explode(F.array("_ahead", "_back")).alias("s")).where("s.r is not null and s.q is not null").select("doc", "key", "s.*").distinct()
    found = cut_lineage(found)
    place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "key", "pos")
    intervals = found.groupBy("n", "r", "q").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = join_frequent(found, intervals, ["n", "r", "q"], "copies").where(place > F.col("first"))
    covered = later.select(F.col("doc").alias("_d"), F.col("key").alias("_k"), F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("_p")).distinct()
    return sa.join(covered, (F.col("pos") == F.col("_p")) & (F.col("key") == F.col("_k")) & F.col("doc").eqNullSafe(F.col("_d"))).select("doc", "key", "line")


def line_runs(lines: DataFrame) -> DataFrame:
    """``doc, key, first_line, n_lines`` of each unbroken run of ``later_copies``."""
    place = F.row_number().over(W.partitionBy("doc", "key").orderBy("line"))
    return lines.withColumn("_g", F.col("line") - place).groupBy("doc", "key", "_g").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines")).drop("_g")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS) -> tuple[DataFrame, str, str]:
    """``docs`` with later copies of repeated line runs deleted from the text, the number of lines before and the number
    deleted; returns the names of these two columns (underscores in front where taken).

    Order is by doc_id (nulls first), then a hash of the text, then the line. A run is one or more lines that are not
    blank, one behind the other (blank lines between them don't count), of ``min_letters`` characters in all; every copy
    but the first goes, overlapping ones included, so each distinct line stays at least once. Rows equal in doc_id and
    text are one document and are all cut alike. A null text stays null and has no lines; a blank line is never deleted.
    """
    cut = later_copies(docs, doc_id, text, min_letters).groupBy("doc", "key").agg(F.collect_set("line").alias("_gone"))
    key, gone, here = fresh(docs, "line_key"), fresh(docs, "line_gone"), fresh(docs, "line_doc")
    n_lines, n_removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    cut = cut.select(F.col("doc").alias(here), F.col("key").alias(key), F.col("_gone").alias(gone))
    joined = docs.join(cut, F.col(doc_id).eqNullSafe(F.col(here)) & (text_key(F.col(doc_id), F.col(text)) == F.col(key)), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = let(lines, lambda all_lines: F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))
    out = F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)
    columns = [out.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    counts = [F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias(n_lines), F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.col(gone))).alias(n_removed)]
    return joined.select(*columns, *counts), n_lines, n_removed
