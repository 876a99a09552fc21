"""Filters by size and first-wins deduplication, by URL and by simhash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessella.functions.text import FNV_BASIS

SMALL_BYTES, BATCH_BYTES = 100, 10_000_000
MIN_TOKENS, MAX_TOKENS = 100, 65_535


def size_reason(size: str = "file_size", batch_bytes: int = BATCH_BYTES) -> Column:
    """'small' or 'large' for files to drop, else null."""
    return F.when(F.col(size) <= SMALL_BYTES, "small").when(F.col(size) >= 2 * batch_bytes, "large")


def length_reason(n_tokens: str | Column) -> Column:
    """'small' or 'large' for documents to drop by their number of tokens, else null."""
    n = F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens
    return F.when(n < MIN_TOKENS, "small").when(n > MAX_TOKENS, "large")


def mark_first(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """df with a boolean: the row has the smallest ``order`` of its key (order is unique).

    The smallest is an aggregate, combined before its shuffle: rows of a key
    never gather in one task.
    """
    first = df.groupBy(key).agg(F.min(order).alias("__first")).select("__first")
    return df.join(first.withColumn(name, F.lit(True)), F.col(order) == F.col("__first"), "left").drop("__first").withColumn(name, F.coalesce(name, F.lit(False)))


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key."""
    return df.join(df.groupBy(key).agg(F.min(order).alias("__first")).select("__first"), F.col(order) == F.col("__first"), "left_semi")


def fnv1_of(words: pa.Array) -> np.ndarray:
    """64-bit FNV-1 hashes of strings, letter by letter for all of them at once."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start, size = offsets[:-1], np.diff(offsets)
    out = np.full(len(words), FNV_BASIS, np.uint64)
    order = np.argsort(-size, kind="stable")  # the longest first: those with a further letter stay in front
    start, size = start[order], -size[order]
    hashes = out[order]
    for k in range(int(-size[0]) if len(size) else 0):
        n = int(np.searchsorted(size, -k))
        hashes[:n] = hashes[:n] * np.uint64(1099511628211) ^ data[start[:n] + k]
    out[order] = hashes
    return out


def simhashes(lists: pa.Array, at_once: int = 500_000) -> np.ndarray:
    """64-bit simhashes, signed, of lists of words: each word's occurrence votes on each bit, ties count as 1.

    The different words of all lists are hashed once; votes are added up list by list.
    """
    words = lists.flatten()
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    coded = words.dictionary_encode() if not isinstance(words, pa.DictionaryArray) else words
    bits = np.unpackbits(fnv1_of(coded.dictionary).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends, out = np.cumsum(counts), np.empty(len(counts), np.int64)
    at = 0
    while at < len(counts):  # so many words at a time
        first = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, first + at_once, "right")))
        own = bits[codes[first : int(ends[stop - 1])]]
        full = counts[at:stop] > 0
        ones = np.zeros((stop - at, 64), np.int64)
        if full.any():
            ones[full] = np.add.reduceat(own, (ends[at:stop] - counts[at:stop] - first)[full], axis=0, dtype=np.int64)
        out[at:stop] = np.packbits(2 * ones >= counts[at:stop, None], axis=1, bitorder="little").view("<i8")[:, 0]
        at = stop
    return out


def simhash_of(words: list[str]) -> int:
    """The simhash of one list of words."""
    return int(simhashes(pa.array([words], pa.list_(pa.string())))[0])


@F.arrow_udf(LongType())
def _simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for words in batches:
        yield pa.array(simhashes(words), pa.int64())


def simhash(words: str | Column) -> Column:
    """Simhash of an array of words: an Arrow UDF, no shuffle of words."""
    return _simhash(F.col(words) if isinstance(words, str) else words)
