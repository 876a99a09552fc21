"""Raw pages to documents: filters, URL dedup, parsing, simhash dedup, dense ids, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessella.functions.html import tag_map, tag_tokens
from tessella.functions.stem import stems
from tessella.functions.text import ngrams, sanitized, strip_html, tokens, url_key
from tessella.operators import grams
from tessella.operators.dedup import BATCH_BYTES, length_reason, mark_first, size_reason
from tessella.plans.storage import kept


def parsed(raw: DataFrame, stemmed: bool = True, tags: Column | None = None) -> DataFrame:
    """raw with original_tokens, tokens (stems), two_grams, three_grams and tag_map (tokens by tag).

    tags: a map of tag texts to use in place of the HTML scanner's.
    """
    texts = tag_map("content") if tags is None else tags
    out = raw.withColumn("original_tokens", tokens(sanitized("content")))
    out = out.withColumn("tokens", stems("original_tokens") if stemmed else F.col("original_tokens"))
    return out.withColumns({"two_grams": ngrams("tokens", 2), "three_grams": ngrams("tokens", 3), "tag_map": tag_tokens(texts)})


def classified(raw: DataFrame, batch_bytes: int = BATCH_BYTES, stemmed: bool = True, html: bool = True) -> DataFrame:
    """Every input (path, url) with why it goes: small, large, duplicate, or null for those that stay.

    The order is that of the filters: file size, URL, number of tokens,
    simhash; a page that a later filter drops still shadows later pages of its
    URL.  Only paths, keys and fingerprints are shuffled.
    """
    sized = raw.withColumn("reason", size_reason("file_size", batch_bytes))
    narrow = sized.select("path", "url", "reason", url_key("url").alias("key"), F.when(F.col("reason").isNull(), F.col("content")).alias("content"))
    narrow = grams.prints(narrow, "content", stemmed, html)
    rows = kept(narrow, "classified")
    alive = mark_first(rows.where("reason is null"), "key", "path", "first")
    alive = alive.withColumn("reason", F.when(~F.col("first"), "duplicate").otherwise(length_reason("n"))).drop("first")
    last = mark_first(alive.where("reason is null"), "print", "path", "first")
    last = last.withColumn("reason", F.when(~F.col("first"), "duplicate")).drop("first")
    columns = ["path", "url", "reason"]
    return rows.where("reason is not null").select(columns).unionByName(alive.where("reason is not null").select(columns)).unionByName(last.select(columns))


def report(marked: DataFrame) -> DataFrame:
    """One row: processed, large, small, duplicate, kept."""
    of = lambda r: F.count_if(F.col("reason").eqNullSafe(F.lit(r)))
    return marked.agg(F.count("*").alias("processed"), of("large").alias("large"), of("small").alias("small"), of("duplicate").alias("duplicate"), of(None).alias("kept"))


def dense_ids(df: DataFrame, order: str) -> DataFrame:
    """(order, doc_id): dense ids from 0 in ascending order, without one task that sees all rows.

    A range sort, the row's place in its partition, and the sizes of the
    partitions before it.
    """
    placed = kept(df.select(order).orderBy(order).withColumn("__m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    from pyspark.sql import Window as W

    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), part == F.col("__p")).select(order, (F.col("__start") + inside).alias("doc_id"))


def parse_documents(raw: DataFrame, batch_bytes: int = BATCH_BYTES, stemmed: bool = True) -> DataFrame:
    """Documents with dense ids: doc_id, url, the parsed columns, raw_size."""
    stay = classified(raw, batch_bytes, stemmed).where("reason is null").select("path")
    ids = dense_ids(stay, "path")
    docs = parsed(raw.join(ids, "path"), stemmed)
    return docs.select("doc_id", "url", "tokens", "two_grams", "three_grams", "original_tokens", "tag_map", F.col("file_size").alias("raw_size"))


def plain_documents(documents: DataFrame, stemmed: bool = True) -> DataFrame:
    """The same columns from plain text (doc_id, text) with ids as given, within the limits of length."""
    raw = documents.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), tokens("text").alias("original_tokens"), F.octet_length("text").cast("long").alias("raw_size"))
    raw = raw.where(length_reason(F.size("original_tokens")).isNull())
    out = raw.withColumn("tokens", stems("original_tokens") if stemmed else F.col("original_tokens"))
    out = out.withColumns({"two_grams": ngrams("tokens", 2), "three_grams": ngrams("tokens", 3), "tag_map": F.create_map().cast("map<string,array<string>>")})
    return out.select("doc_id", "url", "tokens", "two_grams", "three_grams", "original_tokens", "tag_map", "raw_size")


def formatted(doc: Row) -> str:
    """A document as lines: its id and URL, its words, then each tag with its words."""
    lines = [f"{doc['doc_id']} {doc['url']}: {len(doc['tokens'])} tokens", " ".join(doc["tokens"])]
    return "\n".join([*lines, *(f"{tag}: {' '.join(words)}" for tag, words in sorted((doc["tag_map"] or {}).items()))])


__all__ = ["classified", "dense_ids", "formatted", "length_reason", "parse_documents", "parsed", "plain_documents", "report", "size_reason", "strip_html"]
