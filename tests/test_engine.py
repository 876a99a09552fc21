"""Postings, codec, ranking, index and streaming on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import codec, parse, postings, rank
from tessella.plans import index as plan
from tessella.plans.engine import LRU, SearchEngine, formatted
from tessella.sources import pages
from tessella.streaming import ingest

DOCS = "doc_id long, url string, tokens array<string>, two_grams array<string>, three_grams array<string>, original_tokens array<string>, tag_map map<string,array<string>>, raw_size long"


def test_inversion_and_length(spark):
    docs = spark.createDataFrame([(7, "u", ["acm", "machin"], ["acm+machin"], [], ["acm", "machine"], {"title": ["acm"]}, 1)], DOCS)
    got = {(r.term, r.type, r.doc_id, r.tag, r.pos) for r in postings.invert(docs).collect()}
    assert got == {("acm", 0, 7, "", 0), ("acm", 0, 7, "", 65535), ("acm", 1, 7, "title", 0), ("acm+machin", 0, 7, "", 0), ("machin", 0, 7, "", 1), ("machine", 0, 7, "", 65535)}
    assert postings.doc_lengths(docs).first()["doc_len"] == 6
    stay = postings.frequent(postings.term_totals(postings.term_docs(postings.invert(docs)))).collect()
    assert [(r.term, r.n_postings, r.df) for r in stay] == [("acm", 3, 1)]


@pytest.mark.parametrize(
    "posting, data",
    [((0, 5, "", 0), "00050000"), ((0, 300, "", 7), "012c010700"), ((1, 5, "title", 2), "1005010200"), ((1, 70000, "b", 3), "12701101000503 00".replace(" ", "")), ((0, 2**32, "", 65535), "030000000001000000ffff")],
)
def test_codec(spark, posting, data):
    raw = codec.encode_posting(*posting)
    assert raw.hex() == data
    assert list(codec.decode_postings(raw + codec.encode_posting(codec.END))) == [posting]
    row = spark.createDataFrame([posting], "type int, doc_id long, tag string, pos int").select(codec.posting_bytes().alias("n"), codec.posting_header().alias("h")).first()
    assert (row.n, row.h) == (len(raw), raw[0])


def test_dictionary_offsets(spark):
    terms = spark.createDataFrame([("machin+learn", 9), ("acm", 13), ("ac", 4)], "term string, bytes long")
    got = [(r.term, r.start, r.end) for r in codec.dictionary(terms).orderBy("term").collect()]
    assert got == [("ac", 0, 15), ("acm", 15, 40), ("machin+learn", 40, 70)]


PAIRS = [("acm", 0, 0, "", 0), ("acm", 0, 0, "", 1), ("acm", 1, 0, "title", 0), ("acm", 0, 1, "", 0), ("acm", 1, 1, "b", 0), ("machine", 0, 1, "", 2), ("machine", 1, 1, "h1", 0), ("machine", 1, 1, "h2", 0), ("machine", 0, 2, "", 0), ("machin", 0, 1, "", 1), ("machin", 0, 2, "", 1), ("machine+learn", 0, 1, "", 0)]


@pytest.mark.parametrize(
    "terms, want",
    [
        (["acm"], {0: (0.015589371337, 0.366008376097), 1: (0.001238155839, 0.107229444660)}),
        (["acm", "acm"], {0: (0.062357485349, 0.823075573081), 1: (0.004952623355, 0.349240058689)}),
        (["machine", "machin"], {1: (0.012381558389, 0.351190368578), 2: (0, 0)}),
        (["machine+learn"], {1: (0, 0)}),
        (["zzz"], {}),
    ],
)
def test_ranking(spark, terms, want):
    from tessella.functions.text import gram_size

    rows = spark.createDataFrame(PAIRS, "term string, type int, doc_id long, tag string, pos int").withColumn("gram_n", gram_size("term"))
    pairs = postings.term_docs(rows)
    lengths = spark.createDataFrame([(0, "", 413), (1, "", 520), (2, "", 400)], "doc_id long, url string, doc_len long")
    counts = spark.createDataFrame([(1, t, terms.count(t)) for t in sorted(set(terms))], "query_id int, term string, m int")
    for nth, ranker in enumerate((rank.TFIDF, rank.BM25)):
        scored = rank.scores(counts, pairs, postings.term_totals(pairs), lengths, postings.corpus_stats(lengths), ranker)
        assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx({d: s[nth] for d, s in want.items()}, abs=2e-12)
    if terms == ["acm"]:
        assert [r.doc_id for r in rank.top(scored, 1).collect()] == [0]
        assert len(rank.top(scored, 0).collect()) == len(rank.top(scored, -1).collect()) == 2


def _page(n: int, words: str) -> str:
    return f"<title>{words}</title><h1>Head {n}</h1><p>" + " ".join(f"{words} w{n}x{k}" for k in range(60)) + "</p>"


@pytest.fixture(scope="module")
def crawl(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("crawl")
    (root / "site").mkdir()
    rows = [("http://a.com/1", _page(1, "machine learning")), ("https://a.com/1?x", _page(2, "other text")), ("http://a.com/3", "short"), ("http://a.com/4", _page(4, "acm library")), ("http://a.com/5", _page(4, "acm library")), ("http://a.com/6", "x")]
    for k, (url, content) in enumerate(rows):
        (root / "site" / f"{k}.json").write_text(json.dumps({"url": url, "content": content if content != "short" else "some words " * 20, "encoding": "utf-8"}))
    return str(root)


def test_parse_report(spark, crawl):
    raw = pages.crawl(spark, crawl)
    assert raw.count() == 6 and pages.crawl(spark, crawl, 2).count() == 2
    row = parse.report(parse.classified(raw)).first()
    assert row.asDict() == {"processed": 6, "large": 0, "small": 2, "duplicate": 2, "kept": 2}
    docs = parse.parse_documents(raw).select("doc_id", "url").orderBy("doc_id").collect()
    assert [tuple(r) for r in docs] == [(0, "http://a.com/1"), (1, "http://a.com/4")]


def test_index_and_search(spark, crawl, tmp_path):
    docs = parse.parse_documents(pages.crawl(spark, crawl))
    index = plan.build(docs).save(str(tmp_path / "index"))
    terms = [(r.term, r.start, r.end) for r in index.dictionary.orderBy("term").collect()]
    assert all(a[0] < b[0] and a[2] == b[1] for a, b in zip(terms, terms[1:])) and terms[0][1] == 0
    assert terms[-1][2] == plan.sizes(index).first()["list_bytes"]
    found = plan.seek(index, ["acm"])
    assert {r.doc_id for r in found.collect()} == {1}
    assert "PushedFilters: [In(term" in found._jdf.queryExecution().toString() or "EqualTo(term" in found._jdf.queryExecution().toString()
    engine = SearchEngine.open(spark, str(tmp_path / "index"))
    rows = engine.search("ACM library", 5).collect()
    assert [(r.rank, r.doc_id, r.url) for r in rows] == [(1, 1, "http://a.com/4")] and rows[0].score > 0
    assert engine.search("ACM library", 5).collect() == rows and formatted(rows).startswith("1) 1 http://a.com/4 ")
    assert engine.search("nothing here at all zzz", 5, "bm25").collect() == []
    asked = spark.createDataFrame([(1, "ACM library"), (2, "machine")], "query_id int, text string")
    many = engine.search_many(asked, 5).collect()
    assert {(r.query_id, r.doc_id) for r in many} == {(1, 1), (2, 0)}
    assert next(r.score for r in many if r.query_id == 1) == pytest.approx(rows[0].score)


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1009).alias("path"))
    got = [r[0] for r in parse.dense_ids(rows, "path").orderBy("path").select("doc_id").collect()]
    assert got == list(range(1000))


def test_lru():
    made = []
    cache = LRU(2)
    for key in "abacb":
        cache.get(key, lambda k=key: made.append(k))
    assert made == ["a", "b", "c", "b"] and len(cache) == 2


def test_batches_equal_whole(spark, tmp_path):
    rows = [(n, " ".join(f"t{(n * k) % 37}" for k in range(120))) for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), "doc_id long, text string", files_a_batch=1)
    ingest.append_batches(stream, str(tmp_path / "cp"), str(tmp_path / "out"), ingest.plain)
    whole = postings.term_docs(postings.invert(ingest.plain(docs)))
    columns = ["term", "gram_n", "doc_id", "weight", "n_postings", "bytes"]
    assert sorted(map(tuple, ingest.merged_batches(spark, str(tmp_path / "out")).select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def test_first_urls_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("http://a/x?1",), ("http://a/x?2",), ("http://a/y",)], "url string").write.parquet(str(tmp_path / "in"))
    stream = ingest.first_urls(ingest.page_stream(spark, str(tmp_path / "in"), "url string"))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_empty_documents(spark, tmp_path):
    index = plan.build(spark.createDataFrame([], DOCS)).save(str(tmp_path / "index"))
    assert SearchEngine(index).search("anything").collect() == []


def test_postings_of_batches_are_merged_and_compacted(spark, tmp_path):
    """A k-way merge of batches has the postings of the whole, in order and with repeats."""
    rows = [(n, " ".join(f"t{(n * k) % 31}" for k in range(110)), 100 * n) for n in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), "doc_id long, text string, size long", files_a_batch=2)
    ingest.append_batches(stream, str(tmp_path / "cp"), str(tmp_path / "out"), ingest.plain, flush_by=("doc_id", "size"))
    whole = sorted(tuple(r) for r in postings.invert(ingest.plain(docs)).select(*ingest.ORDER).collect())
    assert [tuple(r) for r in ingest.merged_postings(spark, str(tmp_path / "out")).select(*ingest.ORDER).collect()] == whole
    ingest.compact(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    assert [tuple(r) for r in ingest.merged_postings(spark, str(tmp_path / "one")).select(*ingest.ORDER).collect()] == whole
    twice = ingest.merge_lists([postings.invert(ingest.plain(docs))] * 2)
    assert [tuple(r) for r in twice.select(*ingest.ORDER).collect()] == sorted(2 * whole)
    assert postings.distinct_postings(twice).count() == len(set(whole))


def test_flushes_end_on_bytes_or_count(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 6), (3, 1), (4, 1), (5, 1), (6, 20), (7, None)], "n long, size long")
    got = [r.flush for r in ingest.flushes(sizes, "n", "size", most_rows=3, most_bytes=10).orderBy("n").collect()]
    assert got == [0, 0, 1, 1, 1, 2, 3]


def test_pages_on_a_stream(spark, tmp_path):
    """URLs and simhashes count once over the whole run, whatever batch they come in."""
    text = lambda n: " ".join(f"w{n}x{k}" for k in range(130))
    rows = [(0, "http://a/1", text(0)), (1, "http://a/1?x", text(1)), (2, "http://a/2", text(2)), (3, "http://a/3", text(2)), (4, "http://a/4", "short")]
    for n, (i, u, t) in enumerate(rows):
        spark.createDataFrame([(i, u, f"<p>{t}</p>", len(t) + 200)], "path long, url string, content string, file_size long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.page_stream(spark, str(tmp_path / "in"), "path long, url string, content string, file_size long", files_a_batch=2)
    ingest.append_pages(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    kept = {r.doc_id for r in ingest.merged_batches(spark, str(tmp_path / "out")).select("doc_id").distinct().collect()}
    assert len(kept) == 2 and len(kept & {0, 1}) == 1 and len(kept & {2, 3}) == 1


def test_record_codec(spark):
    rows = [(0, 5, "", 0), (0, 300, "", 7), (1, 300, "title", 2)]
    raw = codec.encode_record("café", rows)
    assert raw[:8] == (5).to_bytes(8, "little") and raw[-1] == codec.END * 16 and codec.decode_record(raw) == ("café", rows)
    assert codec.decode_entry(codec.encode_entry("acm", 40)) == ("acm", 40, 13) and codec.decode_int(codec.encode_int(-3)) == (-3, 8)
    with pytest.raises(ValueError):
        codec.decode_string(codec.encode_string("acm")[:-1])
    table = spark.createDataFrame([("acm", k, d, t, p) for k, d, t, p in rows] + [("café", 0, 9, "", 1)], "term string, type int, doc_id long, tag string, pos int")
    pieces = codec.record_pieces(codec.export_records(table)).orderBy("term", "piece").collect()
    whole = b"".join(bytes(r.data) for r in pieces)
    assert whole == codec.encode_record("acm", rows) + codec.encode_record("café", [(0, 9, "", 1)])
    sizes = table.groupBy("term").agg(F.sum(codec.posting_bytes()).alias("bytes"))
    for r in codec.dictionary(sizes).collect():
        assert codec.decode_record(whole[r.start : r.end])[0] == r.term


def test_dictionary_of_many_terms_with_one_beginning(spark):
    terms = spark.range(5000).select(F.format_string("the+%05d", (F.col("id") * 7 % 5003).cast("long")).alias("term"), (F.col("id") % 9).alias("bytes"))
    rows = codec.dictionary(terms.withColumn("x", F.lit(1))).orderBy("term").collect()
    at = 0
    for r in rows:
        assert (r.start, r.end, r.x) == (at, at + 9 + 9 + r.bytes, 1)
        at = r.end


def test_posting_identity(spark):
    row = spark.createDataFrame([(1, 5, "title", 2)], "type int, doc_id long, tag string, pos int").select(postings.posting_id().alias("id"), postings.posting_size().alias("n")).first()
    assert (row.id, row.n) == ("1-5-title-2", 37)


def test_caches(spark, crawl, tmp_path):
    from tessella.plans.engine import CacheMiss, DiskLists, MemoryLists, Unsupported

    index = plan.build(parse.parse_documents(pages.crawl(spark, crawl))).save(str(tmp_path / "index"))
    plain, cached = SearchEngine(index), SearchEngine(index, list_cache=2)
    for text in ("acm library", "machine learning", "acm machine zzz"):
        for ranker in ("tfidf", "bm25"):
            assert cached.search(text, 5, ranker).collect() == plain.search(text, 5, ranker).collect()
    seen = []
    inner = plain.index.dictionary
    object.__setattr__(plain.index, "dictionary", type("Seen", (), {"where": lambda self, c: seen.append(c) or inner.where(c)})())
    assert plain.search("library", 3).count() == 1 and not seen  # its total is remembered
    lists = MemoryLists(1, DiskLists(index))
    assert lists.get("acm") is lists.get("acm") and lists.get("acm").storageLevel.useMemory
    first = lists.get("acm")
    lists.get("librari")
    assert not first.storageLevel.useMemory
    with pytest.raises(Unsupported):
        DiskLists(index).set("acm", first)
    with pytest.raises(CacheMiss):
        MemoryLists(1).get("acm")


def test_crawl_wants_folders(spark, tmp_path):
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "a.json").write_text(json.dumps({"url": "http://a", "content": "x", "encoding": "u"}))
    (tmp_path / "plain.json").write_text("{}")
    with pytest.raises(NotADirectoryError):
        pages.crawl(spark, str(tmp_path))
    assert pages.crawl(spark, str(tmp_path), on_error="skip").count() == 1


def test_command_line(spark, crawl, tmp_path, capsys):
    from tessella.__main__ import main

    assert main(["parse", crawl]) == 0
    assert "http://a.com/1" in capsys.readouterr().out
    assert main(["build", crawl, str(tmp_path / "index")]) == 0
    capsys.readouterr()
    assert main(["search", str(tmp_path / "index"), "acm", "library", "-k", "3"]) == 0
    assert capsys.readouterr().out.startswith("1) 1 http://a.com/4 ")
    (tmp_path / "queries.txt").write_text("acm library\n\nmachine learning\n")
    assert main(["batch", str(tmp_path / "index"), str(tmp_path / "queries.txt")]) == 0
    out = capsys.readouterr().out.splitlines()
    assert [line.split(":")[0] for line in out] == ["acm library", "machine learning"] and "http://a.com/1" in out[1]
