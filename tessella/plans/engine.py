"""Search over a saved index: one query for a person, many at once for a job."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessella.functions.stem import stem, stems
from tessella.functions.text import query_terms, tokens
from tessella.operators import rank
from tessella.plans.index import Index, open_index


class CacheMiss(KeyError):
    """The cache has no such entry."""


class Unsupported(TypeError):
    """The cache can't be written."""


class LRU:
    """The most recently used entries, up to ``capacity``; what falls out is handed to ``dropped``."""

    def __init__(self, capacity: int, dropped: Callable[[object], object] | None = None) -> None:
        self.capacity, self._entries, self._dropped = capacity, OrderedDict(), dropped

    def get(self, key: Hashable, make: Callable[[], object] | None = None) -> object:
        """The entry; without one that of ``make``, and without that CacheMiss."""
        if key in self._entries:
            self._entries.move_to_end(key)
            return self._entries[key]
        if make is None:
            raise CacheMiss(key)
        value = make()
        self.set(key, value)
        return value

    def set(self, key: Hashable, value: object) -> None:
        self._entries[key] = value
        self._entries.move_to_end(key)
        if len(self._entries) > self.capacity:
            _, old = self._entries.popitem(last=False)
            if self._dropped:
                self._dropped(old)

    def __contains__(self, key: Hashable) -> bool:
        return key in self._entries

    def __len__(self) -> int:
        return len(self._entries)


class DiskLists:
    """Term rows of single terms from an index; the filter reaches the scan."""

    def __init__(self, index: Index) -> None:
        self.index = index

    def get(self, term: str) -> DataFrame:
        return self.index.term_docs.where(F.col("term") == term)

    def set(self, term: str, rows: DataFrame) -> None:
        raise Unsupported("lists on disk are written by Index.save")


class MemoryLists:
    """A read-through cache over such lists: the executors keep those of the last terms.

    Lists stay distributed (persisted DataFrames), so a frequent term doesn't
    come to the driver; one that falls out is given up.
    """

    def __init__(self, capacity: int, source: DiskLists | None = None) -> None:
        self._source, self._lists = source, LRU(capacity, lambda rows: rows.unpersist())

    def get(self, term: str) -> DataFrame:
        source = self._source
        return self._lists.get(term, None if source is None else lambda: source.get(term).persist())

    def set(self, term: str, rows: DataFrame) -> None:
        self._lists.set(term, rows.persist())


class SearchEngine:
    """Ranked search with TF-IDF or BM25."""

    SCHEMA = "rank int, doc_id long, url string, score double"

    def __init__(self, index: Index, cache_size: int = 256, stemmed: bool = True, list_cache: int = 0) -> None:
        """list_cache: of how many terms the executors keep the lists; 0: none."""
        self.index, self.stemmed = index, stemmed
        self._results = LRU(cache_size)
        self._totals = LRU(2 * cache_size)
        self._corpus = LRU(1)
        self._lists = MemoryLists(list_cache, DiskLists(index)) if list_cache else None

    @classmethod
    def open(cls, spark: SparkSession, path: str, cache_size: int = 256, stemmed: bool = True, list_cache: int = 0) -> SearchEngine:
        return cls(open_index(spark, path), cache_size, stemmed, list_cache)

    def terms(self, query: str) -> list[str]:
        """A query's words, stems and n-grams without stopwords, repeats and order kept."""
        import re

        from tessella.functions.stopwords import STOPWORDS

        words = re.findall("[a-z0-9]+", query.replace("İ", "i").lower())
        own = [stem(w) for w in words] if self.stemmed else words
        grams = ["+".join(own[i : i + n]) for n in (2, 3) for i in range(len(own) - n + 1)]
        return [t for t in (*words, *own, *grams) if t not in STOPWORDS]

    def search(self, query: str, k: int = 20, ranker: str = rank.TFIDF) -> DataFrame:
        """(rank, doc_id, url, score) of the k best documents; k <= 0: all.

        Results of a query, ranker and k are remembered (k of them, so never
        more than were asked for); without a limit nothing is.
        """
        terms = self.terms(query)
        spark = self.index.term_docs.sparkSession
        if k <= 0:
            return self._plan(terms, k, ranker)
        rows = self._results.get((tuple(terms), ranker == rank.TFIDF, k), lambda: self._plan(terms, k, ranker).collect())
        return spark.createDataFrame(rows, self.SCHEMA)

    def _plan(self, terms: list[str], k: int, ranker: str) -> DataFrame:
        spark = self.index.term_docs.sparkSession
        known = sorted(set(terms))
        counts = spark.createDataFrame([Row(query_id=0, term=t, m=terms.count(t)) for t in known], "query_id int, term string, m int")
        corpus = spark.createDataFrame([self._corpus.get("corpus", self.index.corpus_stats.first)], "doc_count long, avg_doc_len double")
        found = self._document_frequencies(known)
        if not found:
            return spark.createDataFrame([], self.SCHEMA)
        words = spark.createDataFrame(sorted(found.items()), "term string, df long")
        # the terms as literals reach the scan as pushed filters
        if self._lists is None:
            pairs = self.index.term_docs.where(F.col("term").isin(sorted(found)))
        else:
            pairs = reduce(DataFrame.unionByName, map(self._lists.get, sorted(found)))
        scored = rank.scores(counts, pairs, words, self.index.doc_stats, corpus, ranker)
        if k > 0:
            scored = scored.orderBy(F.desc("score"), "doc_id").limit(k)
        return rank.with_urls(rank.top(scored, k), self.index.doc_stats).orderBy("rank").select("rank", "doc_id", "url", "score")

    def _document_frequencies(self, terms: list[str]) -> dict[str, int]:
        """df of those terms that the index knows; of terms asked for before it is remembered, also that there is none."""
        new = [t for t in terms if t not in self._totals]
        got: dict[str, int | None] = dict.fromkeys(new)
        if new:
            got |= {r["term"]: r["df"] for r in self.index.dictionary.where(F.col("term").isin(new)).select("term", "df").collect()}
        out = {t: got[t] if t in got else self._totals.get(t) for t in terms}
        for t in new:
            self._totals.set(t, got[t])
        return {t: df for t, df in out.items() if df is not None}

    def search_many(self, queries: DataFrame, k: int = 20, ranker: str = rank.TFIDF, key: str = "query_id", text: str = "text") -> DataFrame:
        """(key, rank, doc_id, url, score) of the k best documents of every query, in one job."""
        asked = queries.select(key, text, (stems(tokens(text)) if self.stemmed else tokens(text)).alias("__stems"))
        counts = rank.query_counts(asked, query_terms(text, F.col("__stems")), key)
        scored = rank.scores(counts, self.index.term_docs, self.index.dictionary, self.index.doc_stats, self.index.corpus_stats, ranker, key)
        return rank.with_urls(rank.top(scored, k, key), self.index.doc_stats).select(key, "rank", "doc_id", "url", "score")


def formatted(rows: list[Row]) -> str:
    """Results as lines: rank, document, URL, score."""
    return "\n".join(f"{r['rank']}) {r['doc_id']} {r['url']} {r['score']:f}" for r in rows)
