"""Search for lines by words and patterns: each test of a line is made once, with the results of testing line by line."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from labelwright.functions import patterns as P
from labelwright.functions.text import has, index_containing, index_matching, index_of
from labelwright.operators import evidence as E
from labelwright.operators import lines as L

LINES = [["Protein", "made", "in", "MADE IN India"], ["net", "12", "g", "Net Weight 12 g"], ["maximum", "retail price", "M.R.P. 12", None],
         ["Rs", "12.50", "/kg", "Rs 12.50 /kg"], ["MRP:", "12,50", "x\r", "ORIGIŃ a", "́origin"], ["KG 5 Kg", "5 Kg net"], [None], [], None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, ls) for i, ls in enumerate(LINES)], "doc_id long, lines array<string>")


def test_a_position_is_searched_once(spark):
    column = str(index_of(F.col("lines"), lambda s: has(s, "x"))._jc)
    assert len(re.findall("rlike", column, re.IGNORECASE)) == 1


def test_the_price_line_is_built_once(spark):
    lines = L.line_col()
    column = str(L.append_supporting(L.price_line(lines), lines, P.TAX_WORDING)._jc)
    assert column.count(P.BARE_AMOUNT) == 1


@pytest.mark.parametrize("pattern", [p for ps in P.FIELD_PATTERNS.values() for p in ps] + [
    P.PRICE_LABEL, P.CARE_TRIGGER, P.BARE_AMOUNT, r"in$", r"^g", r"[^0-9]{3}", r"\bin\b", r"(?<!\n)net", r"n++"])
def test_patterns_find_what_line_by_line_finds(docs, pattern):
    lines = F.col("lines")
    got = docs.select("doc_id", index_matching(lines, pattern).alias("a"), index_of(lines, lambda s: has(s, pattern)).alias("b"))
    assert [r.doc_id for r in got.collect() if r.a != r.b] == []


def test_words_are_taken_in_list_order(docs):
    found = docs.select(index_containing(F.col("lines"), ["weight", "made", "net"]).alias("n")).collect()
    assert [r.n for r in found] == [1, 3, None, None, None, 1, None, None, None]


def test_one_token_supports_only_as_a_whole_or_a_label(spark):
    boxes = [(0, "Net", 0.5), (1, "MRP", 0.5), (2, "--", 0.5), (3, "MRP Rs 5", 0.5), (4, None, 0.5)]
    row = spark.createDataFrame([(boxes,)], "b array<struct<pos:int,text:string,confidence:double>>").select(E.tokened(F.col("b")).alias("b"))
    pos = lambda text: F.transform(E.supporting(F.col("b"), F.lit(text)), lambda d: d["pos"])
    assert tuple(row.select(pos("net mrp"), pos("Net"), pos("mrp rs 5 net"), pos("-")).first()) == ([1], [0], [1, 3], [])


def test_a_field_falls_back_to_its_patterns(docs):
    found = L.match_keywords(docs, {"a": ["weight"], "b": ["zzz", "net"]}, {"a": [r"\bmade\s+in\b", r"\bkg\b"]})
    rows = {(r.doc_id, r.field, r.n, r.text, r.source) for r in found.collect()}
    assert rows == {(0, "a", 3, "MADE IN India", "pattern"), (1, "a", 3, "Net Weight 12 g", "literal"), (1, "b", 0, "net", "literal"),
                    (3, "a", 2, "/kg", "pattern"), (5, "a", 0, LINES[5][0], "pattern"), (5, "b", 1, LINES[5][1], "literal")}
