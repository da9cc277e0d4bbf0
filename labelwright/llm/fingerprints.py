"""Merkle fingerprints of documents over sections, paragraphs and pieces cut by content, with expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelwright.functions.text import let
from labelwright.llm.common import fresh, text_key
from labelwright.session import cut_lineage

#: A paragraph is cut behind words whose hash is divisible by this, so that an insertion moves no cut but those next to it.
PIECE_WORDS = 8
#: Words longer than this (texts without blanks) are cut behind characters whose code point is.
LONG_WORD = 40
#: Hexadecimal digits of a piece's digest.
DIGITS = 16
CUT = "\x01"
#: Stands for a null id in joins; the key of such a row differs from any of a row with this id.
NO_ID = -(1 << 63)


def section_hashes(text: Column) -> Column:
    """Per section (cut at empty lines) ``struct(hash, paragraphs)``; a paragraph is a line. Both cuts lose nothing."""
    def section(s: Column) -> Column:
        return let(F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)), lambda paragraphs: F.struct(F.sha2(F.array_join(paragraphs, ""), 256).alias("hash"), paragraphs.alias("paragraphs")))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)


def pieces(paragraph: Column) -> Column:
    """Digests of the pieces of a paragraph, in order: leaves of the tree. Cuts depend on the words around them alone."""
    behind = lambda x, hit: F.concat(x, F.when(hit, F.lit(CUT)).otherwise(F.lit("")))
    characters = lambda u: F.array_join(F.transform(F.regexp_extract_all(u, F.lit("(?s)."), F.lit(0)), lambda c: behind(c, F.pmod(F.ascii(c), F.lit(PIECE_WORDS)) == 0)), "")
    inner = lambda u: F.when(F.length(u) > LONG_WORD, characters(u)).otherwise(u)
    words = F.regexp_extract_all(paragraph, F.lit(r"[^ \t]+[ \t]*|[ \t]+"), F.lit(0))
    marked = F.array_join(F.transform(words, lambda u: behind(inner(u), F.pmod(F.xxhash64(u), F.lit(PIECE_WORDS)) == 0)), "")
    return F.transform(F.filter(F.split(marked, CUT), lambda x: x != ""), lambda x: F.substring(F.md5(x), 1, DIGITS))


def fingerprint(text: Column) -> Column:
    """Root of the tree, a colon, and its branches: sections with ``/`` between, their paragraphs with ``.``, the digests
    of a paragraph's pieces with ``,``.

    The root is sha256 over the section hashes, a section over its paragraph hashes, a paragraph over its text, so roots
    are equal exactly when texts are. Null counts as empty.
    """
    root = F.sha2(F.array_join(F.transform(section_hashes(text), lambda s: s["hash"]), ""), 256)
    branch = lambda section: F.array_join(F.transform(F.split(section, "\n"), lambda p: F.array_join(pieces(p), ",")), ".")
    return F.concat(root, F.lit(":"), F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), branch), "/"))


def likeness(left: Column, right: Column) -> Column:
    """1 for equal roots, else twice the pieces in common over the pieces of both; 0 if neither has any.

    The trees are compared from the top: equal sections are not looked into, then equal paragraphs of the others, and only
    pieces of paragraphs that differ are compared. Of equal branches side by side one counts.
    """
    def parts(branches: Column, cut: str) -> Column:
        return F.array_distinct(F.filter(F.flatten(F.transform(branches, lambda x: F.split(x, cut))), lambda x: x != ""))

    def weight(branches: Column) -> Column:
        return F.aggregate(branches, F.lit(0), lambda n, x: n + F.size(F.filter(F.split(x, "[.,]"), lambda p: p != "")))

    def below(a: Column, b: Column, cut: str, then) -> Column:
        return let(parts(F.array_except(a, b), cut), lambda x: let(parts(F.array_except(b, a), cut), lambda y: then(x, y)))

    def share(a: Column, b: Column) -> Column:
        def leaves(pa: Column, pb: Column, whole: Column) -> Column:
            both = whole * 2 + F.size(pa) + F.size(pb)
            return F.when(both > 0, (whole + F.size(F.array_intersect(pa, pb))) * F.lit(2.0) / both).otherwise(F.lit(0.0))
        return let(weight(F.array_intersect(a, b)), lambda sections: below(a, b, r"\.", lambda x, y: let(
            sections + weight(F.array_intersect(x, y)), lambda whole: below(x, y, ",", lambda pa, pb: leaves(pa, pb, whole)))))

    branches = lambda f: parts(F.array(F.substring(f, 66, 1 << 30)), "/")
    same = F.substring(left, 1, 64) == F.substring(right, 1, 64)
    return F.when(same, F.lit(1.0)).otherwise(let(branches(left), lambda a: let(branches(right), lambda b: share(a, b))))


def edits(before: Column, after: Column) -> Column:
    """Branches that differ between two texts: ``array<struct<section, paragraph>>`` (from 0), a missing branch
    included; sections of equal hash are not looked into."""
    def differing(one: Column, two: Column) -> Column:
        def inside(i: Column) -> Column:
            a, b = F.get(one, i)["paragraphs"], F.get(two, i)["paragraphs"]
            width = F.greatest(F.coalesce(F.size(a), F.lit(0)), F.coalesce(F.size(b), F.lit(0)))
            changed = F.filter(F.sequence(F.lit(0), width - 1), lambda j: ~F.get(a, j).eqNullSafe(F.get(b, j)))
            return F.when(F.get(one, i)["hash"].eqNullSafe(F.get(two, i)["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
                F.transform(changed, lambda j: F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(one), F.size(two)) - 1), inside))
    return let(section_hashes(before), lambda a: let(section_hashes(after), lambda b: differing(a, b)))


def neighbours(docs: DataFrame, doc_id: str, text: str, partitions: int) -> DataFrame:
    """``_id, _key, _prev_id, _prev_key, _prev_n``: each document with the one before it by doc_id (nulls first, then a
    hash of the text), the first with the last. Ranges of ids are ordered each by itself; the last document of every
    range (one row each) links them."""
    ids = docs.select(F.col(doc_id).alias("_id"), text_key(F.col(doc_id), F.col(text)).alias("_key"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("_n")).distinct()
    # the ranges are written down: both uses below must see the same ones
    ranged = cut_lineage(ids.repartitionByRange(partitions, F.col("_id").asc_nulls_first(), "_key").withColumn("_range", F.spark_partition_id()))
    me = F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_key", "_n")
    inside = ranged.withColumn("_prev", F.lag(me).over(W.partitionBy("_range").orderBy(F.col("_id").asc_nulls_first(), "_key")))
    ends = ranged.groupBy("_range").agg(F.max(me).alias("_last")).withColumn("_whole", F.lit(0))
    by_range = W.partitionBy("_whole").orderBy("_range")  # as many rows as there are ranges
    ends = ends.select("_range", F.coalesce(F.lag("_last").over(by_range), F.last("_last").over(by_range.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_before"))
    joined = inside.join(F.broadcast(ends), "_range").withColumn("_prev", F.coalesce("_prev", "_before"))
    return joined.select("_id", "_key", F.col("_prev._id").alias("_prev_id"), F.col("_prev._key").alias("_prev_key"), F.col("_prev._n").alias("_prev_n"))


def edited_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", partitions: int = 64) -> DataFrame:
    """``doc_id, text, edited, next_fingerprint``: each text with its last quarter (whole code points, rounded down)
    replaced by as many, or all, of the next document's first.

    The next document is the next by doc_id; null ids come first, rows of one id go by a hash of their text, rows equal
    in both are one document and share its result, and behind the last comes the first (a lone document is its own
    next). Null texts count as empty. Other columns play no part.

    A text is moved once, its head and fingerprint once more to the document before it.
    """
    # both joins deal the text out by the same two plain columns, so it is moved once
    known = lambda c: F.coalesce(c.cast("long"), F.lit(NO_ID))
    base = docs.select(known(F.col(doc_id)).alias("_id"), text_key(F.col(doc_id), F.col(text)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    links = neighbours(docs, doc_id, text, partitions).select(known(F.col("_id")).alias("_i"), F.col("_key").alias("_k"), known(F.col("_prev_id")).alias("_pi"), F.col("_prev_key").alias("_pk"), "_prev_n")
    met = base.join(links, (F.col("_id") == F.col("_i")) & (F.col("_key") == F.col("_k")))
    heads = met.select(F.col("_pi").alias("_i"), F.col("_pk").alias("_k"), F.substring(F.col("_text"), F.lit(1), F.floor(F.col("_prev_n") / 4).cast("int")).alias("_head"),
                       fingerprint(F.col("_text")).alias("next_fingerprint")).groupBy("_i", "_k").agg(F.min(F.struct("_head", "next_fingerprint")).alias("_h"))
    joined = base.join(heads, (F.col("_id") == F.col("_i")) & (F.col("_key") == F.col("_k")))
    n = F.length("_text")
    kept = F.substring(F.col("_text"), F.lit(1), (n - F.floor(n / 4)).cast("int"))
    return joined.select(F.nullif(F.col("_id"), F.lit(NO_ID)).alias("doc_id"), F.col("_text").alias("text"), F.concat(kept, F.col("_h._head")).alias("edited"), F.col("_h.next_fingerprint").alias("next_fingerprint"))


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus its fingerprint (underscores in front if the name is taken). Every row is read alone."""
    return docs.withColumn(fresh(docs, "fingerprint"), fingerprint(F.col(f"`{text}`")))
