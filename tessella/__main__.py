"""python -m tessella parse PAGES | build PAGES INDEX | search INDEX QUERY... | batch INDEX FILE | ask INDEX"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.operators import parse
from tessella.plans.engine import SearchEngine, formatted
from tessella.plans.index import build, sizes
from tessella.sources import pages


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    for name, what in (("build", "an index from a folder of JSON files (two levels) or a Parquet table of pages"), ("parse", "pages parsed, the report and the first documents printed")):
        b = sub.add_parser(name, help=what)
        b.add_argument("pages")
        if name == "build":
            b.add_argument("index")
        else:
            b.add_argument("--show", type=int, default=1, help="how many documents")
        b.add_argument("--files", type=int, default=-1)
    for name in ("search", "ask", "batch"):
        s = sub.add_parser(name)
        s.add_argument("index")
        if name == "batch":
            s.add_argument("queries", help="a file with a query a line; all are answered in one job")
        s.add_argument("-k", type=int, default=20)
        s.add_argument("--ranker", choices=("tfidf", "bm25"), default="tfidf" if name == "search" else "bm25")
        if name == "search":
            s.add_argument("query", nargs="+")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if a.what in ("build", "parse"):
        raw = pages.from_pages(spark.read.parquet(a.pages)) if a.pages.endswith(".parquet") else pages.crawl(spark, a.pages, a.files)
        started = time.time()
        parse.report(parse.classified(raw)).show()
        if a.what == "parse":
            for row in parse.parse_documents(raw).orderBy("doc_id").limit(a.show).collect():
                print(parse.formatted(row))
            return 0
        index = build(parse.parse_documents(raw)).save(a.index)
        sizes(index).show()
        print(f"{time.time() - started:.2f} s")
        return 0
    engine = SearchEngine.open(spark, a.index)
    if a.what == "batch":
        lines = spark.read.text(a.queries).where("trim(value) <> ''").withColumn("n", F.monotonically_increasing_id())
        found = engine.search_many(lines.select("n", F.col("value").alias("text")), a.k, a.ranker, "n")
        for row in lines.join(found, "n").orderBy("n", "rank").toLocalIterator():
            print(f"{row['value']}: {formatted([row])}")
        return 0
    asked = [" ".join(a.query)] if a.what == "search" else iter(lambda: (print("> ", end="", flush=True), sys.stdin.readline())[1], "")
    for query in asked:
        started = time.time()
        rows = engine.search(query.strip(), a.k, a.ranker).collect()
        print(formatted(rows) or "nothing found")
        print(f"{(time.time() - started) * 1000:.0f} ms")
    return 0


if __name__ == "__main__":
    sys.exit(main())
