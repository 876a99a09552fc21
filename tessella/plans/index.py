"""The index: built from documents, saved as Parquet sorted by term, opened again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import codec, grams, postings
from tessella.plans.storage import kept

TABLES = ("lists", "dictionary", "doc_stats", "corpus_stats")


@dataclass(frozen=True)
class Index:
    """One row a term and document, with the positions; the dictionary; documents; the corpus."""

    lists: DataFrame
    dictionary: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """Postings in full."""
        return grams.exploded(self.lists)

    @property
    def term_docs(self) -> DataFrame:
        """What scoring reads."""
        return self.lists.drop("places", "words", "tags")

    def save(self, path: str, compression: str = "zstd") -> Index:
        """Write all tables below path, in term order, and open them."""
        for name in TABLES:  # lists and dictionary come in order
            df: DataFrame = getattr(self, name)
            df.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")
        return open_index(self.lists.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def build(docs: DataFrame | grams.Source, text_weight: float = postings.TEXT_WEIGHT) -> Index:
    """The index of documents (see operators.parse), whose doc_id is unique.

    Terms of one posting go; document lengths count them nevertheless.  The
    dictionary comes first: by its offsets the lists are divided into ranges
    of terms, and what goes between tasks are compressed pieces of lists.
    """
    source = grams.Parsed(docs) if isinstance(docs, DataFrame) else docs
    words = codec.dictionary(postings.frequent(grams.totals(source)))
    lengths = kept(grams.lengths(source), "doc-stats")
    return Index(grams.lists(source, text_weight, grams.ranges(words, lengths)), words, lengths, postings.corpus_stats(lengths))


def sizes(index: Index) -> DataFrame:
    """One row: bytes of the binary term list and dictionary, postings, terms."""
    return sizes_of(index.dictionary)


def sizes_of(terms: DataFrame) -> DataFrame:
    """The same from the frequent terms with n_postings and bytes."""
    return terms.agg(
        F.sum(codec.record_bytes()).alias("list_bytes"), F.sum(codec.entry_bytes()).alias("dictionary_bytes"), F.sum("n_postings").alias("postings"), F.count("*").alias("terms")
    )


def seek(index: Index, terms: list[str]) -> DataFrame:
    """The postings of some terms; the filter reaches the Parquet scan, whose row groups are sorted by term."""
    return index.postings.where(F.col("term").isin(terms))
