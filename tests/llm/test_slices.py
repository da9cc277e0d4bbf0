"""Memory of a worker that hashes or tokenises a batch of texts."""

import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from labelwright.llm import bpe, common
from tests.llm.cases import odd_documents


def test_hashing_a_batch_takes_bounded_memory(monkeypatch):
    monkeypatch.setattr(common, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    text = " ".join(f"word{i % 97} of{i}" for i in range(200))
    texts = pa.array([f"{text} {i}" for i in range(2000)] + [None, "", "a"])
    tracemalloc.start()
    sizes = [len(s) for s in common.shingle_sets(texts, 4)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [398] * 2000 + [0, 0, 1]
    assert peak < 25e6  # slices of 2 MB took 80 MB and more


def test_tokens_of_a_batch_are_handed_on_in_parts():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        content = file.read()
    text = " ".join(f"word{i % 97} of{i % 89}" for i in range(600))
    texts = pa.array([f"{text} {i}" for i in range(1500)] + [None, "", "ä", text * 200])
    work = lambda batches: bpe.round_trip_batches(iter(batches), content, public_tokenizers.PATTERN)
    assert [x.as_py() for part in work([texts[:2], texts[:0], texts[1500:1503]]) for x in part.field("decoded")] == [f"{text} 0", f"{text} 1", "", "", "ä"]
    parts = list(work([texts]))
    assert [x for part in parts for x in part.field("decoded").to_pylist()] == texts.fill_null("").to_pylist()
    # all at once: more than 10 MB of texts and as much of ids; one part holds the longest text
    assert len(parts) > 10 and sorted(part.nbytes for part in parts)[-2] < 2 * bpe.HANDED_BYTES


@pytest.mark.parametrize("own", [None, "32m"])
def test_stages_with_workers_send_small_batches(spark, own):
    name = corpus_pipeline.BATCH_SETTING
    before = spark.conf.get(name, None)
    try:
        for stage in (corpus_pipeline.keep_quality, corpus_pipeline.keep_one_of_each_group, corpus_pipeline.tokenise):
            spark.conf.unset(name) if own is None else spark.conf.set(name, own)
            stage(spark, odd_documents(spark), "/root/testdata/sf0.001")
            assert spark.conf.get(name) in ({own} if own else {corpus_pipeline.BATCH_BYTES, f"{4 << 20}b"})
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
