"""Passage ranking: keyword scores, exact vector scores, rank fusion, query expansion, benchmark queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from labelwright.functions.text import tokens
from labelwright.operators.lookups import contained_entries
from labelwright.session import cut_lineage

BM25_K1, BM25_B = 1.5, 0.75
#: Pairs of query and term that every task may hold; more queries are searched in as many turns as it takes.
QUERY_TERMS = 2_000_000
#: Postings of one term are cut into blocks of so many passages, each with its highest score.
POSTING_BLOCK = 128
#: Passages of one shard of postings hold together at most so many words (or are one longer passage).
SHARD_WORDS = 1_000_000
#: Scores of a pair of blocks are held so many at a time.
SCORE_CELLS = 4_000_000
#: Scores are rounded to six digits, so a bound this far below cannot matter.
_MARGIN = 2e-6


def top_k(scored: DataFrame, query: str, k: int, item: str) -> DataFrame:
    """Best k items per query, ties by item; Spark keeps k per task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.col("score").desc(), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class Postings:
    """The passages of one shard by term, with what each adds to a score, and the highest such value of every block."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, times: np.ndarray, lengths: np.ndarray, idf: np.ndarray, average: float):
        order = np.lexsort((docs, terms))
        terms, self.docs, times = terms[order], docs[order], times[order].astype(float)
        self.n_docs = len(lengths)
        norm = times + BM25_K1 * (1 - BM25_B + BM25_B * lengths[self.docs] / average)
        self.adds = idf[terms] * times * (BM25_K1 + 1) / norm
        self.known, first = np.unique(terms, return_index=True)
        self.first = np.append(first, len(terms))
        starts = [np.arange(a, z, POSTING_BLOCK) for a, z in zip(self.first[:-1], self.first[1:])]
        flat = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.block_of = np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int64)
        self.block_doc = self.docs[flat]
        self.block_most = np.maximum.reduceat(self.adds, flat) if len(flat) else np.zeros(0)
        self.most = np.maximum.reduceat(self.adds, first) if len(first) else np.zeros(0)

    def scores(self, at: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Whole scores of some passages; terms are added in one order whatever the shard."""
        total = np.zeros(len(some))
        for t in np.sort(at):
            a, z = self.first[t], self.first[t + 1]
            place = np.minimum(np.searchsorted(self.docs[a:z], some), z - a - 1) + a
            total += np.where(self.docs[place] == some, self.adds[place], 0.0)
        return total

    def best(self, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Passages that may be among the k best and reach ``floor``, with their scores (MaxScore with block maxima).

        Terms are added from the highest possible gain down. Once all that are left cannot lift a passage without a score
        to the kth, only passages near it are looked up in their lists, and only where their blocks' maxima allow it.
        """
        at = np.searchsorted(self.known, query)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == query)] if len(self.known) else at[:0]
        at = at[np.argsort(-self.most[at], kind="stable")]
        rest = np.append(np.cumsum(self.most[at][::-1])[::-1], 0.0)
        total, least, done = np.zeros(self.n_docs), floor, len(at)
        for i, t in enumerate(at):
            if total.max(initial=0.0) > rest[i] or floor > rest[i]:
                if self.n_docs > k:
                    least = max(least, np.partition(total, self.n_docs - k)[self.n_docs - k])
                if least > rest[i] + _MARGIN:
                    done = i
                    break
            a, z = self.first[t], self.first[t + 1]
            total[self.docs[a:z]] += self.adds[a:z]
        if self.n_docs > k:
            least = max(least, np.partition(total, self.n_docs - k)[self.n_docs - k])
        some = np.flatnonzero((total > 0) & (total + rest[done] >= least - _MARGIN))
        bound = total[some]
        for t in at[done:]:
            block = np.searchsorted(self.block_doc[self.block_of[t]:self.block_of[t + 1]], some, side="right") - 1
            bound = bound + np.where(block >= 0, self.block_most[self.block_of[t] + np.maximum(block, 0)], 0.0)
        some = some[bound >= least - _MARGIN]
        return some, self.scores(at, some)


def _slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring passages that hold together at most ``most`` words, or are one longer passage."""
    upto, start = np.cumsum(lengths), 0
    while start < len(lengths):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield start, stop
        start = stop


def _shards(terms, item: str, kind: pa.DataType, most: int = SHARD_WORDS):
    """One row per slice of a batch: its passages' ids and lengths, and term, passage and number of times of every posting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms.value, pa.string())
        whole = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, t))
        for batch in batches:
            for start, stop in _slices(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64), most):
                ids, held = batch.column(0).slice(start, stop - start), batch.column(1).slice(start, stop - start)
                lengths = pc.list_value_length(held)
                flat = pc.index_in(held.flatten(), wanted)
                passage = np.repeat(np.arange(len(held)), pc.fill_null(lengths, 0).to_numpy())
                hit = flat.is_valid().to_numpy(zero_copy_only=False)
                pairs, times = np.unique(passage[hit] * len(wanted) + flat.drop_null().to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([whole(ids, kind), whole(lengths, pa.int32()), whole(pairs % len(wanted), pa.int32()), whole(pairs // len(wanted), pa.int32()), whole(times, pa.int32())],
                                                 ["ids", "lengths", "terms", "docs", "times"])
    return run


def _search(asked, k: int, item_type: pa.DataType, query_type: pa.DataType):
    """The k best passages of each query in this task, handing the kth score on from shard to shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, terms, idf, average = asked.value
        held: dict[int, list] = {}
        for batch in batches:
            for ids, lengths, *rest in zip(*(c for c in batch.columns)):
                lengths = pc.fill_null(lengths.values, 0).to_numpy().astype(float)
                shard = Postings(*(x.values.to_numpy() for x in rest), lengths, idf, average)
                ids = ids.values.to_pylist()
                for q in range(len(names)):
                    kept = held.get(q, [])
                    floor = -kept[k - 1][0] if len(kept) >= k else 0.0
                    some, scores = shard.best(terms[starts[q]:starts[q + 1]], k, floor)
                    if len(some):
                        held[q] = sorted([*kept, *((-s, ids[i]) for i, s in zip(some.tolist(), np.round(scores, 6).tolist()))])[:k]
        rows = [(names[q], i, -s) for q, kept in held.items() for s, i in kept]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (query_type, item_type, pa.float64()))], ["query", "item", "score"])
    return run


def bm25(queries: DataFrame, passages: DataFrame, k: int = 10, query: str = "query_id", item: str = "passage_id", query_terms: int = QUERY_TERMS) -> DataFrame:
    """Keyword ranking of ``passages(passage_id, text)`` for ``queries(query_id, text)``; ties go to the smaller id.

    The distinct terms of the queries are counted first and handed to every task, in turns where they are more than
    ``query_terms``. Passages stay where they are read: a task turns each batch into postings of the queries' terms,
    Spark adds up how many passages have each term, and the written postings are searched with MaxScore. Only the k
    best of each query and task are shuffled.
    """
    spark = queries.sparkSession
    types = [f.dataType for f in (queries.schema[query], passages.schema[item])]
    query_type, item_type = (to_arrow_schema(StructType([StructField("x", t)])).field(0).type for t in types)
    by_query = cut_lineage(queries.where(F.col(query).isNotNull()).select(query, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct())
    turns = max(1, -(-by_query.count() // query_terms))
    tokened = passages.where(F.col(item).isNotNull()).select(item, tokens(F.col("text")).alias("_t"))
    found = []
    for turn in range(turns):
        mine = by_query.where(F.pmod(F.xxhash64(query), F.lit(turns)) == turn).groupBy(query).agg(F.collect_list("term").alias("terms")).collect()
        vocabulary = sorted({t for r in mine for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        schema = StructType([StructField("ids", ArrayType(types[1]))])
        for column in ("lengths", "terms", "docs", "times"):
            schema.add(column, ArrayType(IntegerType()))
        shards = cut_lineage(tokened.mapInArrow(_shards(spark.sparkContext.broadcast(vocabulary), item, item_type), schema))
        whole = shards.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))).alias("words"),
                           F.sum(F.size(F.filter("lengths", lambda x: x.isNotNull()))).alias("sized")).first()
        held = np.zeros(len(vocabulary))
        for r in shards.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
            held[r["t"]] = r["n"]
        idf = np.log(1 + ((whole["n"] or 0) - held + 0.5) / (held + 0.5))
        average = (whole["words"] / whole["sized"]) if whole["words"] else 1.0
        starts = np.cumsum([0, *(len(r["terms"]) for r in mine)])
        flat = np.array([place[t] for r in mine for t in r["terms"]], np.int64)
        asked = spark.sparkContext.broadcast(([r[query] for r in mine], starts, flat, idf, average))  # at most query_terms pairs, or one query
        out = StructType([StructField(query, types[0]), StructField(item, types[1])]).add("score", "double")
        found.append(shards.mapInArrow(_search(asked, k, item_type, query_type), out))
    scored = found[0]
    for more in found[1:]:
        scored = scored.unionByName(more)
    return top_k(scored, query, k, item)


def _unit_rows(column) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype("float64")
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _block_scorer(k: int, query: str, item: str, cells: int = SCORE_CELLS):
    """The k best vectors of a block for each query of a block; no more than ``cells`` scores are held at a time."""
    import pandas as pd

    def score_blocks(v, q):
        if len(v) == 0 or len(q) == 0:
            return pd.DataFrame({query: [], item: [], "score": []})
        vectors, asked = _unit_rows(v["vec"]).T, _unit_rows(q["vec"])
        ids, picked, found = v["id"].to_numpy(), [], []
        step = max(1, cells // len(v))
        for start in range(0, len(asked), step):
            for row in np.round(asked[start:start + step] @ vectors, 6):
                near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                best = near[np.lexsort((ids[near], -row[near]))[:k]]
                picked.append(ids[best])
                found.append(row[best])
        return pd.DataFrame({query: np.repeat(q["id"].to_numpy(), [len(x) for x in found]), item: np.concatenate(picked), "score": np.concatenate(found)})

    return score_blocks


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", item: str = "vec_id", vector: str = "embedding",
               vector_block: int = 50_000, query_block: int = 2_000) -> DataFrame:
    """Exact cosine top-k: every vector is scored against every query, nothing is left out.

    Both sides are cut into blocks of bounded size and each pair of blocks is one co-grouped task, which scores its
    block with matrix products of a few queries at a time and hands on the best k per query only. What is shuffled is
    the vectors once per query block and k rows per query and vector block.
    """
    n_v = max(1, -(-vectors.count() // vector_block))
    n_q = max(1, -(-queries.count() // query_block))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (vectors.select(F.col(item).alias("id"), F.col(vector).alias("vec"), F.pmod(F.xxhash64(item, vector), F.lit(n_v)).cast("int").alias("vb"))
            .withColumn("qb", others(n_q)))
    right = (queries.select(F.col(query).alias("id"), F.col(vector).alias("vec"), F.pmod(F.xxhash64(query, vector), F.lit(n_q)).cast("int").alias("qb"))
             .withColumn("vb", others(n_v)))
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *vectors.schema.fields]}
    schema = f"{query} {types[query]}, {item} {types[item]}, score double"
    best = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(_block_scorer(k, query, item), schema)
    return top_k(best, query, k, item)


def rrf(rankings: list[DataFrame], k0: int = 60, k: int = 10, query: str = "query_id", item: str = "passage_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    stacked = rankings[0].select(query, item, "rank")
    for r in rankings[1:]:
        stacked = stacked.unionByName(r.select(query, item, "rank"))
    fused = stacked.groupBy(query, item).agg(F.round(F.sum(1.0 / (k0 + F.col("rank"))), 9).alias("score"))
    return top_k(fused, query, k, item)


def expand_queries(queries: DataFrame, synonyms: DataFrame, query: str = "query_id") -> DataFrame:
    """Append the expansion of every pattern a query contains; ``synonyms(pattern, expansion)`` is found by its windows."""
    hits = contained_entries(queries, query, "text", synonyms, "pattern").groupBy(query).agg(
        F.array_join(F.array_sort(F.collect_set("expansion")), " ").alias("_more"))
    j = queries.join(hits, query, "left")
    return j.select(query, F.concat_ws(" ", "text", "_more").alias("text"), F.col("_more").isNotNull().alias("rewritten"))


def retrieval_benchmark(provisions: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Benchmark queries from templates: one row per provision and style, with what is expected.

    The templates are configuration, so they are an array of the row and not a join.
    """
    def row(style: str, text: str) -> Column:
        filled = F.replace(F.replace(F.lit(text), F.lit("{clause}"), F.col("clause")), F.lit("{topic}"), F.replace(F.col("field"), F.lit("_"), F.lit(" ")))
        return F.struct(F.concat_ws("-", F.lit(style), F.col("provision_id").cast("string")).alias("query_id"), F.lit(style).alias("style"), filled.alias("text"))
    rows = F.array(*[row(s, x) for s, x in templates.items()])
    return provisions.select("provision_id", "rule_id", "field", F.inline(rows))
