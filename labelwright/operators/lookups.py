"""Band, threshold and longest-match lookups against small reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.sizing import broadcast_if_small
from labelwright.functions.text import let


def band_lookup(df: DataFrame, bands: DataFrame, value: str, keys: list[str] | None = None, *, low_open: bool = True) -> DataFrame:
    """Attach the band that holds ``value``: ``(low, high]`` or, with ``low_open=False``, ``[low, high]``.

    An open end is NULL. No band leaves NULLs. The bands are broadcast after a check of their number.
    """
    above = (F.col(value) > F.col("low")) if low_open else (F.col(value) >= F.col("low"))
    inside = (F.col("low").isNull() | above) & (F.col("high").isNull() | (F.col(value) <= F.col("high")))
    table = broadcast_if_small(bands, 10_000)
    for k in keys or []:
        inside = inside & (df[k] == table[k])
    joined = df.join(table, inside, "left")
    return joined.drop(*[table[k] for k in keys or []])


def unit_price_units(df: DataFrame, table: DataFrame) -> DataFrame:
    """Unit for the unit price by basis and size; ``table(basis, comparison, threshold, unit, ord)`` in canonical units.

    The first row in order that matches wins; it is picked by an aggregate over the few matching rows.
    """
    t = table.withColumnRenamed("basis", "_basis")
    q, limit = F.col("canonical"), F.col("threshold")
    matches = (F.when(F.col("comparison") == "any", F.lit(True)).when(F.col("comparison") == "<", q < limit)
               .when(F.col("comparison") == "<=", q <= limit).when(F.col("comparison") == ">", q > limit).otherwise(q >= limit))
    joined = df.join(broadcast_if_small(t, 10_000), (F.col("basis") == F.col("_basis")) & matches, "left")
    return joined.groupBy("doc_id").agg(F.min_by("unit_price_unit", "ord").alias("unit_price_unit"))


def magnitude_units(df: DataFrame, table: DataFrame) -> DataFrame:
    """Allowed units by magnitude: below 1 the small unit, from 1 the large one, both exactly at 1."""
    t = table.withColumnRenamed("basis", "_basis")
    joined = df.join(broadcast_if_small(t, 10_000), F.col("basis") == F.col("_basis"), "left")
    q = F.col("canonical")
    allowed = (F.when(q < 1, F.array("unit_below")).when(q == 1, F.array("unit_below", "unit_from")).when(q > 1, F.array("unit_from")))
    return joined.select("doc_id", allowed.alias("allowed_units"))


def _windows(text: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths; of length 0 the empty one."""
    def of_length(chars: Column, n: int) -> Column:
        last = F.size(chars) - (n - 1)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), "")) if n else F.array(F.lit(""))
    return let(F.split(text, ""), lambda chars: F.array_distinct(F.concat(*[of_length(chars, n) for n in lengths])))


def contained_entries(df: DataFrame, key: str, text: str, table: DataFrame, entry: str, gram: int = 4, small: int = 10_000) -> DataFrame:
    """Rows ``(key, *table columns)`` for every entry that a text contains, whatever the case; each entry row once per text row.

    Each entry is filed under its window of ``gram`` characters that the fewest entries have (a shorter entry under itself),
    so a word common to many entries leads to none of them. Texts are joined to the entries by equality of windows, and
    only those met are compared: no text meets the whole table. A table of at most ``small`` rows is broadcast; a longer
    one is shuffled by window, and then the texts do not travel with their windows. NULL texts and entries match nothing; the empty
    entry is in every text.
    """
    low = table.where(F.col(entry).isNotNull()).withColumn("_low", F.lower(entry))
    filed = low.select("_low").distinct().select("_low", F.explode(
        F.when(F.length("_low") < gram, F.array("_low")).otherwise(_windows(F.col("_low"), [gram]))).alias("_gram"))
    common = filed.groupBy("_gram").agg(F.count("*").alias("_n"))
    places = filed.join(common, "_gram").groupBy("_low").agg(F.min(F.struct("_n", "_gram")).alias("_place"))
    index = low.join(places, "_low").withColumn("_gram", F.col("_place._gram")).drop("_place")
    lengths = sorted(r[0] for r in low.select(F.least(F.length("_low"), F.lit(gram))).distinct().collect())  # at most gram + 1 numbers
    columns = [F.col(f"_e.{c}").alias(c) for c in table.columns]
    texts = df.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).where("_text is not null")
    if not lengths:
        return texts.join(low.select(F.struct(*table.columns).alias("_e")).limit(0)).select(F.col("_key").alias(key), *columns)
    entries = index.select("_gram", "_low", F.struct(*table.columns).alias("_e"))
    inside = F.col("_text").contains(F.col("_low"))
    if low.limit(small + 1).count() <= small:
        met = texts.withColumn("_gram", F.explode(_windows(F.col("_text"), lengths))).join(F.broadcast(entries), "_gram").where(inside)
    else:
        names = ["_row", "_twin"]
        texts = texts.withColumns({"_row": F.xxhash64("_key", "_text"), "_twin": F.xxhash64("_text", "_key")})
        windows = texts.dropDuplicates(names).select(*names, F.explode(_windows(F.col("_text"), lengths)).alias("_gram"))
        met = texts.join(windows.join(entries, "_gram").drop("_gram"), names).where(inside)
    return met.select(F.col("_key").alias(key), *columns)


def longest_match(df: DataFrame, table: DataFrame, text: str = "commodity", small: int = 10_000) -> DataFrame:
    """Bases of the longest table entry contained in the text; a tie is UNKNOWN (NULL).

    ``table(entry, bases array<string>)``. Of the entries a document contains the first and the last of the greatest length
    are kept by one aggregate: they are the same row unless there is a tie.
    """
    low = table.where("entry is not null").groupBy(F.lower("entry").alias("_word")).agg(
        F.count("*").alias("_copies"), F.min(F.struct("entry", "bases")).alias("_r"))
    listed = low.select("_word", F.length("_word").alias("_n"), "_copies", "_r.entry", "_r.bases")
    best = contained_entries(df, "doc_id", text, listed, "_word", small=small).groupBy("doc_id").agg(
        F.max(F.struct("_n", "_word", "_copies", "entry", "bases")).alias("_last"), F.min(F.struct(-F.col("_n"), "_word")).alias("_first"))
    single = (F.col("_last._word") == F.col("_first._word")) & (F.col("_last._copies") == 1)
    out = df.select("doc_id").distinct().join(best, "doc_id", "left")
    return out.select("doc_id", F.when(single, F.col("_last.entry")).alias("entry"), F.when(single, F.array_distinct(F.col("_last.bases"))).alias("bases"))
