"""What the vector searches share: valid vectors, and running best results of many queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: str) -> Column:
    """Not null, and without null, NaN or infinite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def rows_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, v array<double>) of the rows that take part: a key and a valid vector."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return df.where(F.col(key).isNotNull() & valid(vector)).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dims float64 matrix, lengths) of an Arrow list column; short rows end in zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    dims = int(lengths.max(initial=0))
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims), lengths
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out, lengths


def widened(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))


class Best:
    """The k best (score, id) of each of n queries: highest score, ties to the smaller id.

    Offers gather in a buffer, which is cut back to the best k of each query
    when it is full; ``floor`` holds each query's k-th best score so far.
    """

    def __init__(self, n: int, k: int, dtype: type = np.float64, lowest: float = -np.inf) -> None:
        self.n, self.k, self.limit = n, k, max(20_000, 4 * n * k)
        self.floor = np.full(n, lowest, dtype)
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._held = self._kept = 0
        self.seen = 0  # candidates met so far, for callers

    def settle(self) -> None:
        """Bring ``floor`` up to date."""
        if self._held > self._kept:
            self._cut()

    def offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self._parts.append((query, ids, score))
            self._held += len(query)
            if self._held > self.limit or self._kept < self.n * self.k:
                self._cut()

    def _cut(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self._parts))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - first[query]
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        keep = rank < self.k
        self._parts = [(query[keep], ids[keep], score[keep])]
        self._held = self._kept = int(keep.sum())

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score), sorted by query, then best first."""
        if not self._parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.floor.dtype)
        self._cut()
        return self._parts[0]
