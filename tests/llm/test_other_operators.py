"""Chats, vectors, WARC records, the pipeline and the registry."""

from __future__ import annotations

import datetime
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import chat, forest, queries, topk, warc
from tessella.llm.common import new_folder
from tests.llm.conftest import documents, prose

CHATS = "conv_id long, turn long, role string, text string, place string, h1 string, block string, part string"


def collected(df):
    return [tuple(r) for r in df.collect()]


# -- chats -------------------------------------------------------------------------------------------


def brute_chats(rows):
    turns = defaultdict(set)
    for c, t, r, x in rows:
        part = lambda v: "0" if v is None else "1" + hashlib.md5(v.encode()).hexdigest()
        key = hashlib.md5((part(r) + part(x)).encode()).hexdigest()
        turns[c].add((t is None, t or 0, r is not None, r or "", key, x is not None, x or ""))
    whole = {c: tuple((r[2], r[3], *r[5:]) for r in sorted(own)) for c, own in turns.items()}
    out = set()
    for c, own in whole.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in whole.values())
        same = [x for x, o in whole.items() if o == own]
        if not longer and c == min(same, key=lambda x: (x is None, x or 0)):
            text = "".join(f"<|im_start|>{r if has else 'unknown'}\n{x}<|im_end|>\n" for has, r, _, x in own)
            out.add((c, len(own), len(same), text))
    return out


@pytest.mark.parametrize("ranges, part", [(4, 1024), (1, 1024), (60, 2)])
def test_chats(spark, monkeypatch, ranges, part):
    monkeypatch.setattr(chat, "PART", part)
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as asked for
    rng = random.Random(1)
    rows = []
    for base in range(8):
        talk = [("user" if k % 2 == 0 else "assistant", f"turn {rng.randint(0, 2)}") for k in range(rng.randint(2, 9))]
        for copy in range(5):
            rows += [(base * 10 + copy, k, *t) for k, t in enumerate(talk[: rng.randint(1, len(talk))])]
    rows += [(300, 0, "user", "x"), (300, 0, "user", "x"), (300, 1, None, "y"), (301, 0, "user", "x"), (302, 0, None, None), (303, 0, "unknown", ""), (304, None, "user", "x"), (None, 0, "user", "z"), (305, -3, "user", "long " * 20_000), (306, 7, "user", "same place"), (306, 7, "user", "another")]
    got = chat.collapse(spark.createDataFrame([(*r, *"xxxx") for r in rows], CHATS)).orderBy("conv_id", "part").collect()
    joined = defaultdict(str)
    for r in got:
        joined[(r.conv_id, r.n_turns, r.copies)] += r.text
    assert {(*k, t) for k, t in joined.items()} == brute_chats(rows)
    assert chat.collapse(spark.createDataFrame([], CHATS)).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turns_of_one_number_spread_over_ranges(spark):
    """A conversation with a third of all turns, all of one number or none, is in several ranges, and right."""
    rows = [(None, None, "user", f"x{n}") for n in range(300)] + [(7, 5, "user", f"y{n}") for n in range(300)] + [(8, 5, "user", f"y{n}") for n in range(300)]
    order = sorted(rows[300:600], key=lambda r: hashlib.md5(("1" + hashlib.md5(b"user").hexdigest() + "1" + hashlib.md5(r[3].encode()).hexdigest()).encode()).hexdigest())
    rows += [(9, k, *r[2:]) for k, r in enumerate(order[:150])]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    chats = spark.createDataFrame([(*r, *"xxxx") for r in rows], CHATS)
    placed = chat.prefixes(chats)
    assert placed.count() == 1050 and placed.where("last").count() == 4
    assert {(r.conv, r.n_turns, r.copies) for r in chat.maximal(placed).collect()} == {(None, 300, 1), (7, 300, 2)}
    assert placed.groupBy("conv").agg(F.countDistinct("place").alias("n"), F.max("place").alias("m")).where("n <> m").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# -- vectors --------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, rank string, score string"
ODD = [(10100, None), (10200, [1.0, None]), (10300, [float("nan"), 1.0]), (10400, [float("inf"), 0.0]), (None, [1.0, 2.0])]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], 0, *"xxxx") for i, v in rows], VECTORS)


def brute_top(rows, k, step, measure, zero=True):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for q, a in {i: min(v for j, v in ok if j == i) for i, _ in ok if i % step == 0}.items():
        found = sorted((-measure(a, b), c) for c, b in ok if c != q)[:k]
        out += [(q, n, c, -s) for n, (s, c) in enumerate(found, 1)]
    return sorted(out)


def whole_product(a, b):
    return max(-(2**63), min(2**63 - 1, sum(int(np.floor(1024 * x)) * int(np.floor(1024 * y)) for x, y in zip(a, b))))


def near_product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def floats(rng, n, dims):
    return [(i, np.float32(rng.normal(size=dims)).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("chunk, block, queries", [(8192, 32768, 512), (16, 2, 1), (64, 5, 2)])
def test_top_k(spark, monkeypatch, chunk, block, queries):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(1)
    rows = floats(rng, 400, 40)
    rows += [(500 + i, rows[i % 7][1]) for i in range(40)] + ODD + [(600, []), (601, [0.5]), (602, [0.0] * 50), (603, [1.0] * 45)]
    got = collected(topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert sorted(got) == brute_top(rows, 10, 100, whole_product)


def test_top_k_of_few_and_of_large_numbers(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.25])]
    assert sorted(collected(topk.top_k(vectors(spark, few), F.col("vec_id") % 100 == 0))) == brute_top(few, 10, 100, whole_product)
    large = [(0, [2.0**40, 1.0]), (1, [2.0**40, 3.0]), (2, [-(2.0**60), 1.0]), (3, [2.0**20, 1.5]), (4, [2.0**20, 1.25])]
    assert sorted(collected(topk.top_k(vectors(spark, large), F.col("vec_id") % 100 == 0))) == brute_top(large, 10, 100, whole_product)
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0


def shaped(kind, rng, n=1500, dims=64):
    m = rng.normal(size=(n, dims))
    if kind == "decaying":
        m *= np.exp(-0.1 * np.arange(dims))
    elif kind == "low rank":
        m[:, 8:] *= 0.01
    elif kind == "one hot":
        m = np.eye(dims)[rng.integers(0, dims, n)] * rng.integers(1, 4, (n, 1))
    elif kind == "clusters":
        m = m * 0.2 + rng.normal(size=(20, dims))[rng.integers(0, 20, n)] * 2
    return np.float32(m).astype(float)


@pytest.mark.parametrize("kind", ["decaying", "low rank", "one hot", "clusters", "plain"])
def test_top_k_where_bounds_prune(spark, kind):
    """Compaction at every block of dimensions gives the same as brute force, and does rule pairs out."""
    m = shaped(kind, np.random.default_rng(6))
    rows = list(enumerate(m.tolist()))
    got = collected(topk.top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert sorted(got) == brute_top(rows, 10, 100, whole_product)
    whole = np.floor(1024 * m)
    best = topk.Best(15, 10, np.int64, np.iinfo(np.int64).min)
    pruned = topk.meet(best, whole[::100], np.arange(0, 1500, 100), whole.T, np.arange(1500))
    assert kind == "plain" or pruned > 15 * 1500 / 10


def test_forest_recall_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24)) * 2
    rows = [(i, np.float32(centres[i % 30] + rng.normal(size=24) * 0.4).astype(float).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(60)] + [(7000 + i, rows[3][1]) for i in range(5)] + [*ODD, (8000, [0.0] * 24), (8020, [1.0] * 3), (20, rows[20][1])]
    table = vectors(spark, rows)
    got = defaultdict(list)
    for q, n, c, s in sorted(collected(forest.nearest(table, F.col("vec_id") % 20 == 0))):
        assert n == len(got[q]) + 1
        got[q].append((c, s))
    unique = list({(i, tuple(v or ())): (i, v) for i, v in rows}.values())
    of = {i: v for i, v in unique if v}
    hit = total = 0
    want = defaultdict(list)
    for q, _, c, s in brute_top(unique, 20, 20, near_product, zero=False):
        want[q].append((c, s))
    assert got.keys() == want.keys()
    for q, true in want.items():
        assert len(got[q]) == 20 and len({c for c, _ in got[q]}) == 20 and q not in {c for c, _ in got[q]}
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and all(s == near_product(of[q], of[c]) for c, s in got[q])
        hit, total = hit + len({c for c, _ in got[q]} & {c for c, _ in true}), total + len(true)
    assert hit / total >= 0.9


def test_forest_search_is_that_of_one_heap():
    import heapq

    rng = np.random.default_rng(7)
    m = rng.normal(size=(4000, 12))
    for cell in (200_000, 500):
        forest.CELL, old = cell, forest.CELL
        try:
            f = forest.Forest.fit(m, float(np.linalg.norm(m, axis=1).max()), len(m))
        finally:
            forest.CELL = old
        assert f.cells == (1 if cell > 4000 else 16) and (f.cell(f.leaf(m)) == f.cell(f.leaf(m)[:, :1])).all()
        for q, got in zip(m[:20], f.search(m[:20], 40)):
            along = f.raised(q[None], query=True)[0].astype(np.float64)
            heap, cost = [(0.0, t, 1) for t in range(forest.TREES)], {}
            while len(cost) < 60:
                far, t, node = heapq.heappop(heap)
                if node >= f.leaves:
                    cost[t * f.leaves + node - f.leaves] = far
                    continue
                gap = float(f.normals[t, node].astype(np.float64) @ along - f.cuts[t, node])
                heapq.heappush(heap, (far + (gap**2 if gap < 0 else 0), t, 2 * node + 1))
                heapq.heappush(heap, (far + (gap**2 if gap >= 0 else 0), t, 2 * node))
            assert len(set(got.tolist())) == 40
            assert np.allclose([cost.get(x, np.inf) for x in got.tolist()], sorted(cost.values())[:40], atol=1e-4)


def test_forest_compares_few_on_clusters():
    rng = np.random.default_rng(8)
    m = rng.normal(size=(200, 32))[rng.integers(0, 200, 20_000)] * 2 + rng.normal(size=(20_000, 32)) * 0.3
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    f = forest.Forest.fit(m, float(np.linalg.norm(m, axis=1).max()), len(m))
    asked = m[::200]
    most = forest.calibrated(f, m, asked, 20, 1.0)
    block = forest.Block(np.arange(len(m)), m, f.leaf(m).astype(np.int64) + np.arange(forest.TREES) * f.leaves)
    q, c, _ = block.best(np.arange(0, 20_000, 200), asked, list(f.search(asked, most)), 20)
    s = asked @ m.T
    s[np.arange(100), np.arange(0, 20_000, 200)] = -np.inf
    true = np.argsort(-s, axis=1)[:, :20]
    hit = sum(len(set(c[q == i].tolist()) & set(true[i].tolist())) for i in range(100))
    assert hit / 2000 >= 0.9 and block.compared < 0.1 * s.size


def test_forest_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELL", 100)
    rng = np.random.default_rng(9)
    rows = floats(rng, 1000, 8)
    got = collected(forest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0))
    true = {(q, c) for q, _, c, _ in brute_top(rows, 20, 20, near_product)}
    assert len(got) == 1000 and len({(q, c) for q, _, c, _ in got} & true) >= 0.9 * len(true)


def test_forest_of_few(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [-1.0, 0.5])]
    assert sorted(collected(forest.nearest(vectors(spark, few), F.col("vec_id") % 20 == 0))) == brute_top(few, 20, 20, near_product)
    copies = [(i, [0.75, 1.0]) for i in range(60)] + [(100, [1.0, 0.0])]
    assert sorted(collected(forest.nearest(vectors(spark, copies), F.col("vec_id") % 20 == 0))) == brute_top(copies, 20, 20, near_product)
    assert forest.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


# -- WARC ------------------------------------------------------------------------------------------------


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a?y=2&x=1#f", "https://user@example.com:443/a?x=1&y=2", "example.com/a?x=1&&y=2"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://h.com", "http://h.com/", "http://h.com:8080/A", "", None, "  ", "http://h.com?q"]], "url string")
    got = [r[0] for r in rows.select(warc.canonical_url("url")).collect()]
    assert got == ["example.com/a?x=1&y=2"] * 3 + ["h.com/", "h.com/", "h.com:8080/A", None, None, None, "h.com/?q"]


def _day(n):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(days=n)


RECORDS = [
    ("a", "response", "http://h/x", _day(1), 200, {"ETag": '"1"', "Content-Type": "text/html", "Cache-Control": "old"}, b"one"),
    ("b", "response", "http://h/x", _day(5), 200, {"ETag": '"2"', "Last-Modified": "m"}, b"two"),
    ("c", "revisit", "http://www.h/x#z", _day(2), 304, {"etag": 'W/"1"', "Cache-Control": "new", "Content-Type": "no", "X": "y"}, b""),
    ("d", "revisit", "http://h/x", _day(6), 304, {"ETag": '"1"'}, b""),
    ("e", "revisit", "http://h/x", _day(6), 304, {"Last-Modified": "m"}, None),
    ("f", "revisit", "http://h/x", _day(0), 304, {"ETag": '"1"'}, b""),
    ("g", "revisit", "http://h/x", _day(7), 304, None, b""),
    ("h", "revisit", None, _day(7), 304, {"ETag": '"1"'}, b""),
    ("i", "revisit", "http://h/x", None, 304, {"ETag": '"1"'}, b""),
    ("j", "revisit", "http://h/x", _day(5), 304, {"ETag": '"2"'}, b""),
]


@pytest.mark.parametrize("ranges", [64, 2])
def test_revisits(spark, monkeypatch, ranges):
    monkeypatch.setattr(warc, "RANGES", ranges)
    records = spark.createDataFrame(RECORDS + RECORDS[3:4], warc.SCHEMA).withColumn("canonical", F.lit("x")).withColumn("at", F.lit(0))
    resolved = warc.resolve(records)
    got = {r.record_id: r for r in resolved.collect()}
    assert resolved.count() == 11
    state = {k: (r.resolution, r.original_id) for k, r in got.items()}
    assert state == {"a": ("response", None), "b": ("response", None), "c": ("resolved", "a"), "d": ("mismatch", None), "e": ("resolved", "b"), "f": ("missing", None), "g": ("unverified", None), "h": ("missing", None), "i": ("missing", None), "j": ("resolved", "b")}
    assert got["c"].headers == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "new", "x": "y"} and got["c"].status == 200
    assert got["d"].headers == {"etag": '"1"'} and got["d"].status == 304 and got["g"].headers == {}
    bodies = {r.record_id: r.body for r in warc.with_bodies(resolved, records.where("kind = 'response'")).collect()}
    assert bytes(bodies["c"]) == b"one" and bytes(bodies["e"]) == b"two"


def test_many_captures_of_one_url_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"r{n}", rng.choice(["response", "revisit"]), rng.choice(["http://h/hot", "http://h/hot", "http://h/b"]), _day(rng.randint(0, 40)), 200, {"ETag": f'"{rng.randint(0, 1)}"'}, b"") for n in range(300)]
    got = {r.record_id: (r.resolution, r.original_id) for r in warc.resolve(spark.createDataFrame(rows, warc.SCHEMA)).collect()}
    for i, kind, url, date, _, headers, _ in rows:
        before = [(d, j, h) for j, k, u, d, _, h, _ in rows if k == "response" and u == url and d <= date]
        if kind == "response":
            want = ("response", None)
        elif not before:
            want = ("missing", None)
        else:
            last = max(before, key=lambda x: x[:2])
            want = ("resolved", last[1]) if last[2] == headers else ("mismatch", None)
        assert got[i] == want


@pytest.mark.parametrize("ranges", [64, 2])
def test_revisits_pass_over_responses_that_are_not_full(spark, monkeypatch, ranges):
    monkeypatch.setattr(warc, "RANGES", ranges)
    tag = {"ETag": '"1"'}
    rows = [("a", "response", "http://h/x", _day(1), 200, tag, b"whole"), ("z", "revisit", "http://h/x", _day(9), 304, tag, b"")]
    rows += [(f"p{n}", "response", "http://h/x", _day(n + 2), status, headers, b"part") for n, (status, headers) in enumerate([(206, tag), (503, None), (301, {"ETag": '"2"'}), (304, tag), (None, tag)])]
    rows += [("b", "response", "http://h/y", _day(1), 404, tag, b"none"), ("y", "revisit", "http://h/y", _day(9), 304, tag, b"")]
    resolved = warc.resolve(spark.createDataFrame(rows, warc.SCHEMA))
    got = {r.record_id: (r.resolution, r.original_id, r.status) for r in resolved.collect()}
    assert got["z"] == ("resolved", "a", 200) and got["y"] == ("missing", None, 304)
    assert got["p0"] == ("response", None, 206) and got["p4"] == ("response", None, None) and got["b"] == ("response", None, 404)


def test_digests_are_of_joined_bodies(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://h/", "x"), (None, None, None), (None, None, None), (3, "", "y")], "page_id long, url string, html string")
    md5 = lambda b: hashlib.md5(b).hexdigest()
    got = sorted((r.record_id, r.digest) for r in warc.resolved_pages(pages).collect())
    second = lambda n: md5(f"second text of {n}".encode())
    empty = lambda n, marks: [(m + n, md5(b"")) for m in marks]
    want = [("r1", md5(b"x")), ("v1", md5(b"x")), ("s1", second(1)), ("x1", second(1))] + 2 * [*empty("-", "rvwy"), ("s-", second("-"))] + [("r3", md5(b"y")), *empty("3", "uv")]
    assert got == sorted(want)
    inner = warc.with_bodies
    monkeypatch.setattr(warc, "with_bodies", lambda *a: inner(*a).withColumn("body", F.lit(b"other")))
    assert {r.digest for r in warc.resolved_pages(pages).collect()} == {md5(b"other")}


def test_profiles_and_repeated_headers():
    def member(kind, profile, http):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: i\r\nWARC-Target-URI: http://h/\r\nContent-Length: {len(http)}\r\n"
        return (head + (f"WARC-Profile: {profile}\r\n" if profile else "")).encode() + b"\r\n" + http

    http = b"HTTP/1.1 200 OK\r\nLink: a\r\nlink: b\r\nX: y\r\n\r\nbody"
    found = warc.parse(member("response", None, http))
    assert dict(found["headers"]) == {"link": "a, b", "x": "y"} and found["kind"] == "response" and found["body"] == b"body"
    base = "http://netpreserve.org/warc/1.0/revisit/"
    kinds = [warc.parse(member("revisit", p and base + p, http))["kind"] for p in ("server-not-modified", "identical-payload-digest", None)]
    assert kinds == ["revisit", "other-revisit", "revisit"] and warc.parse(member("request", None, http)) is None


def test_other_revisits_and_repeated_headers_of_a_table(spark):
    rows = [("a", "response", "http://h/", _day(1), 200, {"ETag": '"1"', "LINK": "a", "Link": "b"}, b"x"), ("b", "other-revisit", "http://h/", _day(2), 200, {"ETag": '"1"'}, b""), ("c", None, "http://h/", _day(2), 200, {}, b""), ("d", "revisit", "http://h/", _day(3), 304, {"ETag": '"1"'}, b"")]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, warc.SCHEMA)).collect()}
    assert {k: r.resolution for k, r in got.items()} == {"a": "response", "b": "other", "c": "other", "d": "resolved"}
    assert got["d"].original_id == "a" and got["d"].headers["link"] in ("a, b", "b, a") and got["b"].status == 200


def test_warc_files(spark):
    records = spark.createDataFrame([r for r in RECORDS if r[2]] + [("k", "response", "http://h/y", _day(1), 200, {"A": "b"}, bytes(range(256)) * 500)], warc.SCHEMA)
    folder = new_folder(spark, "test-warc")
    back = {r.record_id: r for r in warc.read(spark, folder, warc.write(records, folder)).collect()}
    assert back.keys() == {r.record_id for r in records.collect()}
    for r in records.collect():
        assert (back[r.record_id].kind, back[r.record_id].url, back[r.record_id].date, back[r.record_id].status) == (r.kind, r.url, r.date, r.status)
        assert bytes(back[r.record_id].body) == bytes(r.body or b"") and back[r.record_id].headers == {k.lower(): v for k, v in (r.headers or {}).items()}
    empty = spark.createDataFrame([], warc.SCHEMA)
    assert warc.resolve(empty).count() == 0 and warc.read(spark, folder, warc.write(empty, folder)).count() == 0
    pages = spark.createDataFrame([(1, "http://h/", "x"), (None, None, None), (3, "", "y")], "page_id long, url string, html string")
    assert warc.resolved_pages(pages).count() == 12


def test_bodies_are_fetched_from_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "AHEAD", 600)  # so that members lie across what is read at once
    big = bytes(range(256)) * 40
    noise = random.Random(8).randbytes(5_000)
    rows = RECORDS + [("k", "response", "http://h/y", _day(1), 200, {"ETag": '"1"'}, noise), ("l", "response", "http://h/z", _day(1), 200, {"ETag": '"3"'}, b""), ("m", "revisit", "http://h/z", _day(2), 304, {"ETag": '"3"'}, b"")]
    rows += [("n", "response", "http://h/w", _day(1), 206, {}, big)] + [(f"o{n}", "revisit", "http://h/y", _day(n + 2), 304, {"ETag": '"1"'}, None) for n in range(40)] + 2 * [("p", "response", "http://h/v", None, 200, {}, big)]
    folder = new_folder(spark, "test-fetch")
    files = warc.write(spark.createDataFrame(rows, warc.SCHEMA).repartition(3), folder)
    whole, places = warc.read(spark, folder, files), warc.read(spark, folder, files, bodies=False)
    assert "body" not in places.columns and places.where("place is null").count() == sum(not r[6] for r in rows)
    of = lambda out: sorted((r.record_id, r.resolution, r.original_id or "", r.body and bytes(r.body)) for r in out.collect())
    got = of(warc.with_bodies(warc.resolve(places, F.col("place")).withColumnRenamed("digest", "place"), folder))
    assert got == of(warc.with_bodies(warc.resolve(whole), whole)) and len(got) == len(rows)
    bodies = {r[0]: r[3] for r in got}
    assert bodies["k"] == bodies["o0"] == bodies["o39"] == noise and bodies["n"] == bodies["p"] == big and bodies["c"] == b"one" and bodies["m"] is None and bodies["d"] is None


def test_bodies_are_read_once_and_not_shuffled(spark):
    pages = spark.createDataFrame([(n, f"http://h/{n % 7}", f"text {n}") for n in range(40)], "page_id long, url string, html string")
    plan = warc.resolved_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    above, fetch, below = plan.partition("MapInArrow")
    assert fetch and "MapInArrow" not in below and "body" not in below.split("\n", 1)[1]  # no other pass over the files
    assert not any(x in above for x in ("Join", "Aggregate", "Repartition", "Sort"))


# -- pipeline and registry -----------------------------------------------------------------------------


def test_stages(spark, tmp_path, awkward, nothing):
    labels = [(n, int(n % 3 != 0), 0) for n in range(400)]
    rng = random.Random(9)
    rows = [(n, ("X!! " * 50 if n % 3 == 0 else prose(rng, 40) + "\nfooter of the site"), f"s{n % 2}") for n in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (documents(spark, rows), awkward, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = stage(spark, docs, str(tmp_path)).cache()
            if name != "bpe":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
            if name in ("quality", "near-dedup"):
                assert docs.count() <= before
            if name == "lines":
                assert docs.count() == before
                if table.count() == 400:
                    assert docs.where("text like '%footer%'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "shard", "row"]
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "lines", "near-dedup", "mixing", "bpe"]


def test_registry():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
