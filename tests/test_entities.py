"""HTML entities: named, numeric, and without semicolons."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.entities import unescape
from tessella.functions.html import tag_tokens


@pytest.mark.parametrize(
    "text, want",
    [
        ("it&#8217;s &#x27;a&#X27; &#39b", "it’s 'a' 'b"),
        ("a&mdash;b caf&eacute; caf&eacute", "a—b café café"),
        ("a &amp b&ampc &ltd &notit;", "a & b&c <d ¬it;"),
        ("&amp;lt; &amp;#8217;", "&lt; &#8217;"),
        ("&#150; &#0; &#xD800; &#99999999999; &#1;", "– � � � \x01"),
        ("&nosuch; & &# &#x; &;", "&nosuch; & &# &#x; &;"),
        (None, None),
        ("", ""),
    ],
)
def test_unescape(text, want):
    assert unescape(text) == want


def test_tokens_of_pages_with_entities(spark):
    rows = spark.createDataFrame([("<p>it&#8217;s a&mdash;b</p> caf&eacute; &#x27;q&#x27; R&amp",), (None,)], "x string")
    assert [r[0] for r in rows.select(T.tokens(T.sanitized("x"))).collect()] == [["it", "s", "a", "b", "caf", "q", "r"], []]


def test_tokens_of_tags_with_entities(spark):
    rows = spark.createDataFrame([({"h1": ["a&mdash;b", "c &amp", "d&#x27;e"], "b": []},), ({},), (None,)], "x map<string,array<string>>")
    got = [r[0] for r in rows.select(tag_tokens(F.col("x"))).collect()]
    assert got == [{"h1": ["a", "b", "c", "d", "e"], "b": []}, {}, None]
