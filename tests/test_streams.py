"""Streams give the batch result however the rows fall into triggers."""

import pytest

from labelwright.plans import catalog, queries_streaming

PATH = "/root/testdata/sf0.001"
KINDS = {"signup": "submit", "view": "view", "purchase": "decide"}


def brute(events):
    keys = sorted({f"{r['user_id']}:{r['event_type']}:{int(r['value'] // 1)}" for r in events})
    counts, states = {}, {}
    for r in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        day = (str(r["ts"])[:10], r["event_type"])
        counts[day] = counts.get(day, 0) + 1
        kind = KINDS.get(r["event_type"])
        if not kind:
            continue
        status, n = states.get(r["user_id"], (None, 0))
        if kind == "submit" and status in (None, "DECISION_RECORDED"):
            status = "PENDING_OFFICIAL_REVIEW"
        elif kind == "view" and status == "PENDING_OFFICIAL_REVIEW":
            status = "UNDER_OFFICIAL_REVIEW"
        elif kind == "decide" and status is not None:
            status, n = "DECISION_RECORDED", n + 1
        states[r["user_id"]] = (status, n)
    return {"x2_dedupe_submissions": [(k,) for k in keys], "x3_review_state": sorted((u, *s) for u, s in states.items()),
            "x4_status_counts": sorted((*d, n) for d, n in counts.items())}


@pytest.fixture(scope="module")
def in_files(spark, tmp_path_factory):
    """The events in five files, in no order of time."""
    folder = tmp_path_factory.mktemp("streams")
    events = spark.read.parquet(f"{PATH}/events.parquet")
    events.repartition(5, "event_id").write.parquet(f"{folder}/events.parquet")
    return str(folder), brute(events.selectExpr("*", "cast(ts as timestamp) as _t").drop("ts").withColumnRenamed("_t", "ts").collect())


@pytest.mark.parametrize("name", ["x2_dedupe_submissions", "x3_review_state", "x4_status_counts"])
def test_one_file_per_trigger(spark, in_files, monkeypatch, name):
    monkeypatch.setattr(queries_streaming, "FILES_PER_TRIGGER", 1)
    folder, want = in_files
    rows = catalog.QUERIES[name](spark, folder).collect()
    got = [(r["idempotency_key"],) if name[1] == "2" else (r["revision_id"], r["status"], r["decisions"]) if name[1] == "3" else (str(r["day"]), r["bucket"], r["n"]) for r in rows]
    assert sorted(got) == want[name]
