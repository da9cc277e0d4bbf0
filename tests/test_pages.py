"""Character references and markup of pages against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from labelwright.functions.entities import unescape
from labelwright.operators import listing


def test_references_as_the_standard_library_reads_them(spark):
    rng = random.Random(2)
    names = list(html5)
    texts = [f"a &{n} b" for n in names[::7]] + [f"&{n.rstrip(';')}x;&{n}" for n in rng.sample(names, 150)]
    texts += [f"&#{n};" for n in (0, 1, 9, 10, 11, 13, 14, 31, 38, 127, 128, 129, 150, 159, 160, 8217, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10 ** 12, 10 ** 40)]
    texts += [f"&#x{n:x}" for n in (0, 0x20B9, 0x1F600, 0x110000, 16 ** 20)] + ["&#X20b9;z", "&#x0000000020B9;"]
    texts += ["", "&", "&&", "a & b", "&amp;lt;", "&;", "&#;", "&#x;", "&#xg", "&unknown;", "&copy2020", "&notit;", "&lt", "x&amp", "&AMP;&ampamp;", "no references", "?a=1&b=2&copy=3"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", unescape(F.col("text")).alias("t")).collect()
    assert [(texts[r.i], r.t) for r in got if r.t != html.unescape(texts[r.i])] == []
    assert spark.createDataFrame([(None,)], "text string").select(unescape(F.col("text")).alias("t")).first().t is None


PAGE = """<!DOCTYPE html><html><head><title>T &#8217; &hellip;</title><meta name="a" content='x > y &copy;'><style>p > a {}</style></head>
<body><p title="a > b" data-x='"'>one &lt; two</p>1 < 2 and 3 > 2<!-- <p>no</p> --><br/>three<?php hidden ?><b>bo</b>ld <a href="?x=1&copy=2">link</a>
<script>var a = "<p>no</p>";</script>&nbsp;<p>last<script>never closed <p>no</p>"""


def test_page_text(spark):
    row = listing.page_parts(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain <!-- open")], "page_id int, html string")).orderBy("page_id").collect()
    assert row[0].title == "T ’ …" and row[0].meta == {"a": "x > y ©"}
    assert row[0].text_lines == ["one < two", "1 < 2 and 3 > 2", "three", "bo", "ld", "link", "last"]
    assert not row[1].text_lines and row[2].text_lines == [] and row[3].text_lines == ["plain"]
