"""TF-IDF and BM25 over one row for each term of a document, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
TFIDF, BM25 = "tfidf", "bm25"
ASKED_TERMS = 200_000


def query_counts(queries: DataFrame, terms: Column, key: str = "query_id") -> DataFrame:
    """(key, term, m): each query's terms and how often it has them."""
    return queries.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("m"))


def _tfidf() -> Column:
    tf = F.col("m") * F.col("weight") / F.col("doc_len")
    return F.col("m") * tf * (F.lit(1.0) + F.ln((F.col("doc_count") + F.lit(1.0)) / (F.col("df") + F.lit(1.0))))


def _bm25() -> Column:
    tf = F.col("m") * F.col("weight")
    n = F.col("doc_count").cast("double")
    idf = F.ln((n - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + F.lit(1.0))
    part = tf / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_doc_len")))
    return F.col("m") * idf * part


def scores(counts: DataFrame, pairs: DataFrame, totals: DataFrame, lengths: DataFrame, corpus: DataFrame, ranker: str = TFIDF, key: str = "query_id") -> DataFrame:
    """(key, doc_id, score) of every document with any of a query's terms; any ranker but 'tfidf' is BM25.

    counts: (key, term, m); pairs: term_docs; totals: terms with df; lengths:
    (doc_id, doc_len), unless pairs have doc_len; corpus: one row.  The queries' terms meet the totals
    first, so terms that the corpus lacks go before the large table is joined.
    """
    few = F.broadcast if counts.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS else (lambda df: df)  # no shuffle of the large table then
    known = totals.select("term", "df").join(few(counts), "term")
    own = "doc_len" in pairs.columns  # of the document, beside the pair
    rows = pairs.select("term", "doc_id", "weight", *["doc_len"] * own).join(few(known), "term")
    rows = rows if own else rows.join(lengths.select("doc_id", "doc_len"), "doc_id")
    stats = corpus.first()  # one row
    rows = rows.withColumns({"doc_count": F.lit(stats["doc_count"]), "avg_doc_len": F.lit(stats["avg_doc_len"]).cast("double")})
    return rows.groupBy(key, "doc_id").agg(F.sum(_tfidf() if ranker == TFIDF else _bm25()).alias("score"))


def asked_postings(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """The postings of the queries' terms: the first thing to do, before anything is totalled.

    The terms are broadcast up to ``ASKED_TERMS`` of them (counted first), and joined by a shuffle beyond.
    """
    terms = counts.select("term").distinct()
    return postings.join(F.broadcast(terms) if terms.count() <= ASKED_TERMS else terms, "term", "left_semi")


def asked_pairs(source, counts: DataFrame, text_weight: float, unique: bool = True) -> DataFrame:
    """term_docs, with doc_len, of the queries' terms, which are looked up while the documents' words are grouped.

    Beyond ``ASKED_TERMS`` of them all term_docs are made and joined by a shuffle.  unique: no doc_id is repeated.
    """
    from tessella.operators import grams
    from tessella.operators.postings import merged

    terms = counts.select("term").distinct()
    if terms.count() > ASKED_TERMS:
        rows = grams.pairs(source, text_weight).join(terms, "term", "left_semi")
        return rows if unique else merged([rows])
    rows = grams.pairs(source, text_weight, sorted(r["term"] for r in terms.collect()))
    return rows if unique else merged([rows.drop("doc_len")])


def top(scored: DataFrame, k: int, key: str = "query_id", digits: int | None = None) -> DataFrame:
    """The k best documents of each query with their rank, equal scores by doc_id; k <= 0: all.

    digits: scores are compared after rounding.
    """
    by = F.round("score", digits) if digits is not None else F.col("score")
    order = W.partitionBy(key).orderBy(by.desc(), F.col("doc_id"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k <= 0 else ranked.where(F.col("rank") <= k)


def with_urls(best: DataFrame, lengths: DataFrame) -> DataFrame:
    """best with url, '' where there is none; joined after the limit."""
    return best.join(lengths.select("doc_id", "url"), "doc_id", "left").withColumn("url", F.coalesce("url", F.lit("")))
