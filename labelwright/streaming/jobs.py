"""Structured Streaming jobs: evaluation of arriving documents, replay removal, review state, daily counts.

Each job takes a streaming DataFrame and a folder for its checkpoint and output. Results are written per
micro-batch under the batch id, so a batch that runs again after a lost executor replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from labelwright.session import shared_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_parquet(stream: DataFrame, folder: str, transform: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> str:
    """Drain what is available, one output folder per micro-batch; returns the output path."""
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return out


def read_output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")


def stream_evaluate(stream: DataFrame, folder: str, evaluate: Callable[[DataFrame], DataFrame]) -> str:
    """The batch evaluation applied to each arriving set of documents, unchanged; stateless by document."""
    return run_to_parquet(stream, folder, evaluate)


def stream_dedupe_submissions(stream: DataFrame, key: str) -> DataFrame:
    """Drop repeated submissions of a key, however late they come: the keys seen are kept for good."""
    return stream.dropDuplicates([key])


def stream_review_state(stream: DataFrame) -> DataFrame:
    """Review status per revision from ``(revision_id, kind, ts, event_id)`` with kind submit, view or decide.

    Viewing moves only a pending item; deciding again is allowed; a decided item reopens only by a submission.
    The order is by ``ts, event_id`` (nulls last), whatever trigger an action arrives in. What is kept per revision is what
    late actions can still change: the first submission, the decisions before it, the number of those after it and the last one,
    the submissions behind that, and the last view.
    """
    import pandas as pd

    def advance(key, batches, state):
        submits, decides, counted, viewed = state.get if state.exists else ([], [], 0, [])
        submits, decides, viewed = ([tuple(x) for x in kept] for kept in (submits, decides, viewed))
        for rows in batches:
            for kind, at, event in zip(rows["kind"], rows["at"], rows["event"]):
                {"submit": submits, "decide": decides, "view": viewed}[kind].append((int(at), int(event)))
        status, viewed = None, [max(viewed)] if viewed else []
        if submits:
            first, last = min(submits), max(decides, default=(0, 0))
            later = [x for x in decides if x > first]
            # the last decision stays among the kept ones and is counted when another one takes its place
            counted += max(0, len(later) - 1)
            behind = [x for x in submits if x > last] if later else [first]
            decides = [x for x in decides if x < first] + ([last] if later else [])
            status = "DECISION_RECORDED" if not behind else "UNDER_OFFICIAL_REVIEW" if viewed and viewed[0] > min(behind) else "PENDING_OFFICIAL_REVIEW"
            submits = sorted({first, *(x for x in submits if not later or x > last)})
            decisions = counted + bool(later)
        else:
            decisions = 0
        state.update(([list(x) for x in submits], [list(x) for x in decides], counted, [list(x) for x in viewed]))
        yield pd.DataFrame({"revision_id": [key[0]], "status": [status], "decisions": [decisions]})

    never = F.lit(2 ** 63 - 1)
    placed = stream.where("kind in ('submit', 'view', 'decide')").select("revision_id", "kind", F.coalesce(F.unix_micros("ts"), never).alias("at"), F.coalesce(F.col("event_id").cast("long"), never).alias("event"))
    return placed.groupBy("revision_id").applyInPandasWithState(
        advance, "revision_id long, status string, decisions long", "submits array<array<long>>, decides array<array<long>>, counted long, viewed array<array<long>>", "update",
        GroupStateTimeout.NoTimeout)


def stream_status_counts(stream: DataFrame, ts: str, bucket: str) -> DataFrame:
    """Rows per day and bucket; late rows count too: the counts of all days are kept."""
    return (stream.groupBy(F.window(ts, "1 day").alias("w"), bucket).agg(F.count("*").alias("n"))
            .select(F.to_date(F.col("w.start")).alias("day"), bucket, "n"))


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of each key by batch."""
    carried = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*carried), "batch_id").alias("_v")).select(*keys, "_v.*")
