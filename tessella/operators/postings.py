"""Inversion of documents to postings, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, TAG = 0, 1
NO_POSITION = 65_535
WEIGHTS = {"title": 5.0, "h1": 3.0, "h2": 2.0, "h3": 1.0, "b": 0.5, "i": 0.5}
TEXT_WEIGHT = 0.0
_POSTING = "array<struct<term:string,gram_n:int,type:tinyint,tag:string,pos:int>>"


def _as_postings(terms: Column, size: int, kind: int, tag: Column, pos) -> Column:
    return F.transform(terms, lambda t, i: F.struct(t.alias("term"), F.lit(size).alias("gram_n"), F.lit(kind).cast("tinyint").alias("type"), tag.alias("tag"), pos(i).cast("int").alias("pos")))


def invert(docs: DataFrame) -> DataFrame:
    """(term, gram_n, type, doc_id, tag, pos): stems and their n-grams by position, original words, words in tags.

    One generator over each document's own arrays, so documents are scanned and
    parsed once.
    """
    place = lambda i: i
    nowhere = lambda i: F.lit(NO_POSITION)
    tagged = F.flatten(F.transform(F.map_entries("tag_map"), lambda e: _as_postings(e["value"], 1, TAG, e["key"], lambda i: i % 65_536)))
    text = [_as_postings(F.col(c), n, TEXT, F.lit(""), f) for c, n, f in (("tokens", 1, place), ("original_tokens", 1, nowhere), ("two_grams", 2, place), ("three_grams", 3, place))]
    rows = docs.select("doc_id", F.inline(F.concat(*text, tagged).cast(_POSTING)))
    return rows.select("term", "gram_n", "type", "doc_id", "tag", "pos")


def posting_id() -> Column:
    """A posting's identity within its term: type-doc_id-tag-pos."""
    return F.format_string("%d-%d-%s-%d", F.col("type").cast("int"), "doc_id", "tag", "pos")


def posting_size() -> Column:
    """Bytes of a posting in memory: four words and its tag."""
    return F.lit(32) + F.octet_length("tag")


def distinct_postings(postings: DataFrame) -> DataFrame:
    """Postings of which a term has each identity once (merging keeps repeats)."""
    return postings.dropDuplicates(["term", "type", "doc_id", "tag", "pos"])


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, url, doc_len): the number of postings that a document makes.

    By arithmetic on the number of its words: a stem for each, and every
    neighbouring two and three.  So no stem or n-gram is made for it.
    """
    tags = F.aggregate(F.map_values("tag_map"), F.lit(0), lambda n, x: n + F.size(x))
    words = F.size("original_tokens")
    return docs.select("doc_id", "url", (2 * words + F.greatest(words - 1, F.lit(0)) + F.greatest(words - 2, F.lit(0)) + tags).cast("long").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: doc_count, avg_doc_len."""
    return lengths.agg(F.count("*").alias("doc_count"), F.avg("doc_len").alias("avg_doc_len"))


def weight(text_weight: float = TEXT_WEIGHT) -> Column:
    """A posting's weight: by its tag, doubled for each further word of an n-gram."""
    by_tag = F.lit(text_weight)
    for tag, w in WEIGHTS.items():
        by_tag = F.when(F.col("tag") == tag, F.lit(w)).otherwise(by_tag)
    return F.when(F.col("type") == TEXT, F.lit(text_weight)).otherwise(by_tag) * F.pow(F.lit(2.0), F.col("gram_n") - 1)


def term_docs(postings: DataFrame, text_weight: float = TEXT_WEIGHT) -> DataFrame:
    """(term, gram_n, doc_id, weight, n_postings, bytes): one row for each term of a document."""
    from tessella.operators.codec import posting_bytes

    w = weight(text_weight)
    return postings.groupBy("term", "gram_n", "doc_id").agg(F.sum(w).alias("weight"), F.count("*").alias("n_postings"), F.sum(posting_bytes()).cast("long").alias("bytes"))


def term_totals(pairs: DataFrame) -> DataFrame:
    """(term, gram_n, df, n_postings, bytes) from term_docs, whose rows are unique by term and doc_id; unions go through :func:`merged` first."""
    return pairs.groupBy("term", "gram_n").agg(F.count("*").alias("df"), F.sum("n_postings").alias("n_postings"), F.sum("bytes").alias("bytes"))


def frequent(totals: DataFrame) -> DataFrame:
    """Terms of more than one posting whose name has fewer than 65,535 bytes."""
    return totals.where((F.col("n_postings") > 1) & (F.octet_length("term") < 65_535))


def vocabulary(kept_terms: DataFrame) -> DataFrame:
    """(gram_n, terms, postings) over the terms that are kept."""
    return kept_terms.groupBy("gram_n").agg(F.count("*").alias("terms"), F.sum("n_postings").alias("postings"))


def merged(parts: list[DataFrame], apart: bool = False) -> DataFrame:
    """term_docs of several batches as one: weights and counts add up.

    apart: no document is in two batches, so no row meets another and there is nothing to add.
    """
    from functools import reduce

    rows = reduce(DataFrame.unionByName, parts)
    if apart:
        return rows
    return rows.groupBy("term", "gram_n", "doc_id").agg(F.sum("weight").alias("weight"), F.sum("n_postings").alias("n_postings"), F.sum("bytes").alias("bytes"))
