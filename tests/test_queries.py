"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    fixed = [tuple(round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order) for r in data]
    return sorted(columns), sorted(fixed, key=repr)


def compare(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["url_dedup", "tokenize", "simhash_dedup", "parse_report", "doc_len", "dictionary_offsets", "codec_round_trip", "index_seek", "tfidf_topk", "bm25_topk_text", "merge_partials", "sanitize_pages", "stream_postings", "doc_urls", "posting_ids"])
def test_query(spark, name):
    compare(spark, name)


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
