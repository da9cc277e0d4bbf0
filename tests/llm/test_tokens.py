"""Tokens equal those of the public library, and decoding gives every text back."""

import random

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from labelwright.llm import bpe
from labelwright.llm.queries import token_digests
from tests.llm.cases import LONG, no_documents, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.parse_ranks(file.read())


@pytest.fixture(scope="module")
def machine(ranks):
    return bpe.Transducer(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_pieces(machine, library):
    rng = random.Random(3)
    alphabet = "aaabbcdeeehilnorsttu  \n\t'.,0123äé中\U0001F600"
    cut = regex.compile(public_tokenizers.PATTERN)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert machine.encode(cut.findall(text)) == library.encode_ordinary(text), text


def test_long_pieces(machine, library):
    for text in ("a" * 5000, "ab" * 3000, "=" * 777, "thethethe" * 300, " " * 3000):
        assert list(machine.encode_piece(text.encode())) == library.encode_ordinary(text) or text.isspace()
    cut = regex.compile(public_tokenizers.PATTERN)
    assert machine.encode(cut.findall(" " * 3000 + "x")) == library.encode_ordinary(" " * 3000 + "x")


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = bpe.decode_documents(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    for r in rows:
        assert list(r["ids"]) == library.encode_ordinary(r["text"])
        assert r["decoded"] == r["text"]


def test_states_are_dropped_without_harm(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 50)
    monkeypatch.setattr(bpe, "LOOKAHEAD", 3)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    small = bpe.Transducer(ranks)
    cut = regex.compile(public_tokenizers.PATTERN)
    for text in ("Some ordinary sentences, with words.", LONG[:3000], "ünïcödé tèxt"):
        assert small.encode(cut.findall(text)) == library.encode_ordinary(text)


def test_incremental_utf8(ranks):
    rng = random.Random(1)
    tokens = {i: bytes([i]) for i in range(256)}
    for _ in range(3000):
        data = bytes(rng.choice((0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xEF, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0)) for _ in range(rng.randint(0, 9)))
        decoder = bpe.StreamingDecoder(tokens)
        got = "".join(decoder.feed([b]) for b in data) + decoder.finish()
        assert got == data.decode("utf-8", "replace"), data


def test_odd_rows(spark, library):
    docs = odd_documents(spark)
    out = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    assert out.columns == [*docs.columns, "_ids"]
    for r in out.collect():
        assert list(r["_ids"]) == library.encode_ordinary(r["text"] or "")
    apart = bpe.decode_documents(out, PATH, ids="_ids", text="back").select("_ids", "back")
    both = bpe.round_trip_documents(docs, PATH, public_tokenizers.PATTERN, decoded="back")
    assert both.columns == [*docs.columns, "_ids", "back"]
    assert sorted(map(repr, both.select("_ids", "back").collect())) == sorted(map(repr, apart.collect()))
    assert bpe.round_trip_documents(no_documents(spark), PATH, public_tokenizers.PATTERN).count() == 0
    digests = token_digests(docs)
    assert digests.where("n_tokens = 0").count() == 3
    assert digests.join(docs.where("doc_id = 4").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id").where("h = decoded_sha256").count() == 1
    assert token_digests(no_documents(spark)).count() == 0
