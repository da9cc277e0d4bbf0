"""Streaming queries: the given tables replayed as files; each result equals its batch form (survey X, S10)."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.operators import evidence as E
from labelwright.operators import rollup as A
from labelwright.plans import views
from labelwright.plans.queries_rollup import FLAGSHIP_FIELDS, FLAGSHIP_SQL, rollup_sql
from labelwright.plans.registry import query
from labelwright.sources import sinks
from labelwright.streaming import jobs


#: So many files at most are one trigger; results do not depend on it.
FILES_PER_TRIGGER = 64


def replay(t, name: str) -> DataFrame:
    """A given table, one file or a folder of part files, as a file stream; a pattern may match either."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(f"{t.path}/{name}.parque[t]")


def _events(t):
    return replay(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("x1_stream_evaluate", f"with {FLAGSHIP_SQL}, ru as ({rollup_sql('st', 'doc_id')}) select doc_id, status, compliant, non_compliant, low_confidence, score from ru", ("keywords", "detections"))
def _(t):
    def evaluate(batch: DataFrame) -> DataFrame:
        docs = views.label_docs(SimpleNamespace(part=batch, supplier=t.supplier, nation=t.nation))
        checked = A.check_documents(E.with_fields(docs, FLAGSHIP_FIELDS), 2026, 6, FLAGSHIP_FIELDS)
        return A.rollup_in_row(checked).select("doc_id", "status", "compliant", "non_compliant", "low_confidence", "score")
    out = jobs.stream_evaluate(replay(t, "part"), jobs.new_folder(t.spark, "evaluate"), evaluate)
    return jobs.read_output(t.spark, out).drop("batch_id")


@query("x2_dedupe_submissions", "select user_id || ':' || event_type || ':' || floor(value)::bigint as idempotency_key from events group by 1")
def _(t):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor("value").cast("string"))
    stream = jobs.stream_dedupe_submissions(_events(t).select(key.alias("idempotency_key")), "idempotency_key")
    out = jobs.run_to_parquet(stream, jobs.new_folder(t.spark, "dedupe"))
    return jobs.read_output(t.spark, out).select("idempotency_key")


_KIND = "case event_type when 'signup' then 'submit' when 'view' then 'view' when 'purchase' then 'decide' end"


@query("x3_review_state", f"""with e as (select user_id as r, {_KIND} as kind, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('signup', 'view', 'purchase')),
 s as (select r, min(n) filter (where kind = 'submit') s0 from e group by 1), d as (select s.r, s0, max(n) filter (where kind = 'decide' and n > s0) d, count(*) filter (where kind = 'decide' and n > s0) c from s join e using (r) group by 1, 2),
 b as (select d.r, s0, d, c, case when d is null then s0 else min(n) filter (where kind = 'submit' and n > d) end as base from d join e using (r) group by 1, 2, 3, 4),
 v as (select b.*, (select count(*) from e where e.r = b.r and kind = 'view' and n > base) as views from b)
 select r as revision_id, case when s0 is null then null when base is null then 'DECISION_RECORDED' when views > 0 then 'UNDER_OFFICIAL_REVIEW' else 'PENDING_OFFICIAL_REVIEW' end as status, c as decisions from v""")
def _(t):
    actions = _events(t).where("event_type in ('signup', 'view', 'purchase')").select(
        F.col("user_id").alias("revision_id"), F.expr(_KIND).alias("kind"), "ts", "event_id")
    out = jobs.run_to_parquet(jobs.stream_review_state(actions), jobs.new_folder(t.spark, "review"), mode="update")
    return jobs.latest(jobs.read_output(t.spark, out), ["revision_id"])


@query("x4_status_counts", "select ts::date as day, event_type as bucket, count(*) as n from events group by 1, 2")
def _(t):
    counts = jobs.stream_status_counts(_events(t).withColumnRenamed("event_type", "bucket"), "ts", "bucket")
    out = jobs.run_to_parquet(counts, jobs.new_folder(t.spark, "counts"), mode="update")
    return jobs.latest(jobs.read_output(t.spark, out), ["day", "bucket"])


@query("s10_metrics_records", "select event_type as unit, count(*) as checks, round(avg(value), 6) as mean from events group by 1")
def _(t):
    records = t.events.groupBy(F.col("event_type").alias("unit")).agg(F.count("*").alias("checks"), F.round(F.avg("value"), 6).alias("mean"))
    folder = jobs.new_folder(t.spark, "metrics")
    sinks.write_metrics_jsonl(records, records.agg(F.sum("checks").alias("checks")), folder)
    return t.spark.read.schema("unit string, checks bigint, mean double").json(f"{folder}/records")
