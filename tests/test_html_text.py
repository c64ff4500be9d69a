"""Visible text of pages: character references and tags."""

from __future__ import annotations

import html

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx


def through(spark, texts, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.x for r in df.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def test_references_as_browsers_decode_them(spark):
    texts = ["caf&eacute; &#8212; it&#x27;s &#X1F600;", "&amp;lt; &lt;b&gt;", "&#0; &#xD800; &#1114112; &#150;", "AT&T; R&D & co &unknown; &;", "", "plain", "&", "&&amp;&", "&Omega;&sect;&frac12;", "a&#39;b&quot;", "&#65"]
    got = through(spark, [*texts, None], tx.decoded)
    assert got[:-1] == [html.unescape(t) if t != "&#65" else t for t in texts] and got[-1] is None


@pytest.mark.parametrize(
    "page,want",
    [
        ('<a title="x>y">link</a>', "link"),
        ("<a title='x>y\"z' href=\"q'>\">link</a>", "link"),
        ('<a title="open>shown</a> <b>end</b>', "shown end"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<!DOCTYPE html><head><title>t</title></head><p>a</p><!-- <p>no</p> --><script>if (a<b) {}</script><style>p{}</style>b&nbsp;c", "a b c"),
        ("<p>" + "<i a='1'>x</i> " * 3000 + "</p>", "x " * 2999 + "x"),
        ("<i " + "a='1' " * 20_000 + ">x</i>", "x"),
    ],
)
def test_tags(spark, page, want):
    assert through(spark, [page], tx.html_text) == [want]
