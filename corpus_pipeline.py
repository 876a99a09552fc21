"""A corpus from documents to token digests, stage by stage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, lines, mixing, quality, setsketch
from tessella.llm.common import table, written
from tessella.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, that the quality classifier doesn't reject."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def unboiled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their sources' boilerplate lines; n_chars follows the text."""
    out = lines.drop_boilerplate(docs.select(*COLUMNS))
    chars = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return setsketch.keep_one(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in training order: by file, then by row."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every document that the earlier stages leave.

    shard and row are a document's place in the files that the mix was written
    to, so ordered by them the result is in training order (null where docs
    don't come from such files).
    """
    return bpe.digests(_placed(docs), tokenizer_file("word_bpe_49k.json"), ("shard", "row"))


def _placed(docs: DataFrame) -> DataFrame:
    """docs with shard, the number of the Parquet file, and row, the place in it."""
    shard = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    try:
        return docs.select(*COLUMNS, F.when(shard != "", shard).cast("int").alias("shard"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # no files
        return docs.select(*COLUMNS, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("row"))


STAGES = [("quality", good), ("lines", unboiled), ("near-dedup", distinct), ("mixing", mixed), ("bpe", tokens)]

#: SQL has neither the classifier, the sketches nor the tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
