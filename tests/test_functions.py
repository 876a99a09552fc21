"""Text functions against worked-out cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.html import tag_texts
from tessella.functions.stem import stem, stems
from tessella.functions.stopwords import STOPWORDS
from tessella.operators.dedup import simhash, simhash_of


def values(spark, rows, column, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).select(column).collect()]


def test_tokens(spark):
    rows = ["Don't x_y, café 3.14", "", None, "İstanbul"]
    assert values(spark, rows, T.tokens("x")) == [["don", "t", "x", "y", "caf", "3", "14"], [], [], ["istanbul"]]


def test_sanitized_tokens(spark):
    rows = ["a&amp;b &lt;c&gt;", "<li>a</li><li>b</li>", 'x<script>var t="</p>";</script>y', "a<!-- b -->c"]
    assert values(spark, rows, T.tokens(T.sanitized("x"))) == [["a", "b", "c"], ["ab"], ["xy"], ["ac"]]


def test_markup_is_stripped_as_a_tokenizer_does(spark):
    rows = [
        """caf&eacute; &#65;bc &hellip; it&rsquo;s <a title="x>y">z</a><script>var q""",
        "a <b title='>q'>b</b> < c > d <5 e",
        "one<!-- <script> -->two<!-- never closed three",
        "<p don't>four</p><img alt=\"five six>seven",
        "<title>t</title>u<STYLE x=\">\">v</style >w<object><p>x</object>y<!DOCTYPE z>",
    ]
    want = [["caf", "abc", "it", "s", "z"], ["a", "b", "c", "d", "5", "e"], ["onetwo"], ["four"], ["uwy"]]
    assert values(spark, rows, T.tokens(T.sanitized("x"))) == want


@pytest.mark.parametrize("n, want", [(2, [[], [], ["a+b"], ["a+b", "b+c", "c+d"]]), (3, [[], [], [], ["a+b+c", "b+c+d"]]), (4, [[], [], [], ["a+b+c+d"]])])
def test_ngrams(spark, n, want):
    assert values(spark, [[], ["a"], ["a", "b"], ["a", "b", "c", "d"]], T.ngrams("x", n), "x array<string>") == want


def test_url_key(spark):
    urls = ["http://h.com/a?x=1#f", "https://h.com/a", "http://u@h.com:80/a%20b", "http://H.com/a", "http://h.com/a/", "http://h.com/a+b"]
    assert values(spark, urls, T.url_key("x")) == ["h.com/a", "h.com/a", "h.com:80/a b", "H.com/a", "h.com/a/", "h.com/a+b"]


def test_fnv_and_simhash(spark):
    of = dict(zip(["a", "machin", "learn"], values(spark, ["a", "machin", "learn"], T.fnv1("x"))))
    assert {w: f"{h & (1 << 64) - 1:016x}" for w, h in of.items()} == {"a": "af63bd4c8601b7be", "machin": "88ba9b6c01cb22db", "learn": "9542c36b0006b1b9"}
    print_ = lambda words: f"{simhash_of(words) & (1 << 64) - 1:016x}"
    assert print_(["machin"]) == print_(["machin", "learn", "machin"]) == "88ba9b6c01cb22db"
    assert print_(["machin", "learn"]) == print_(["learn", "machin"]) == "9dfadb6f01cfb3fb"
    assert values(spark, [["machin", "learn"], []], simhash("x"), "x array<string>") == [simhash_of(["machin", "learn"]), -1]


def test_simhashes_of_many_lists():
    import random

    import pyarrow as pa

    from tessella.operators.dedup import fnv1_of, simhashes

    rng = random.Random(3)
    lists = [[rng.choice(["a", "machin", "learn", "caf\u00e9", "x" * 40, ""]) for _ in range(rng.randint(0, 30))] for _ in range(50)] + [None, []]

    def slow(words):
        votes = [0] * 64
        for w in words or []:
            h = 14695981039346656037
            for b in w.encode():
                h = (h * 1099511628211 % 2**64) ^ b
            votes = [v + (1 if h >> k & 1 else -1) for k, v in enumerate(votes)]
        total = sum(1 << k for k, v in enumerate(votes) if v >= 0)
        return total - (1 << 64) if total >> 63 else total

    for at_once in (7, 10**6):
        assert simhashes(pa.array(lists, pa.list_(pa.string())), at_once).tolist() == [slow(x) for x in lists]
    assert [f"{h:016x}" for h in fnv1_of(pa.array(["a", "", "machin"])).tolist()] == ["af63bd4c8601b7be", "cbf29ce484222325", "88ba9b6c01cb22db"]


@pytest.mark.parametrize(
    "word, want",
    [("machine", "machin"), ("learning", "learn"), ("software", "softwar"), ("engineering", "engin"), ("ahmed", "ahm"), ("very", "veri"), ("consistency", "consist"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("kiwis", "kiwi"), ("dying", "die"), ("agreed", "agre"), ("by", "by"), ("say", "say"), ("succeeded", "succeed"), ("relational", "relat"), ("knackeries", "knackeri")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_stems_column(spark):
    assert values(spark, [["hoping", "cries", "hoping"], [], None], stems("x"), "x array<string>") == [["hope", "cri", "hope"], [], None]


def test_stopwords():
    assert len(STOPWORDS) == 173 and sum("'" in w for w in STOPWORDS) == 50


@pytest.mark.parametrize(
    "page, want",
    [
        ("<title>A  B</title><h1>Foo <b>Bar</b></h1>", {"title": ["A B"], "h1": ["Foo"], "b": ["Bar"]}),
        ("<strong>x</strong><em>y</em>", {"b": ["x"], "i": ["y"]}),
        ("<h2><a>z</a></h2>", {}),
        ("<h3></h3>", {}),
        ("<p><b>one<br><p>two</p><footer>three</footer>", {"b": ["one", "two", "three"]}),
        (None, {}),
    ],
)
def test_tag_texts(page, want):
    assert tag_texts(page) == want


def test_query_terms(spark):
    rows = spark.createDataFrame([("ACM",), ("Iftekhar ahmed",), ("machine learning",), ("to be",), ("the",), ("master of software engineering",)], "x string")
    got = [r[0] for r in rows.withColumn("s", stems(T.tokens("x"))).select(T.query_terms("x", F.col("s"))).collect()]
    assert got[:5] == [["acm", "acm"], ["iftekhar", "ahmed", "iftekhar", "ahm", "iftekhar+ahm"], ["machine", "learning", "machin", "learn", "machin+learn"], ["to+be"], []]
    assert got[5] == "master software engineering master softwar engin master+of of+softwar softwar+engin master+of+softwar of+softwar+engin".split()
