"""Exact top-k search by inner product: columnar branch and bound.

Candidates are packed into chunks in vertical layout, one array for each
dimension.  Queries are packed into blocks.  A chunk meets a block: partial
products accumulate one block of dimensions after another, the dimensions with
the queries' largest mass first; after each, a candidate stays only where its
partial product plus the most that the remaining mass allows (product of both
remaining norms) reaches the query's k-th best score so far, and the surviving
pairs are compacted.  What survives all dimensions has its exact score.

Each block of ``BLOCK`` queries meets all chunks, in ``groups`` tasks a block,
so work is spread by blocks and groups and no side is broadcast or collected;
candidates are sent once for every block.  A task holds one block (16 MB for 64
dimensions) and one chunk, which ``QUERIES`` of them meet at a time, and returns
its k best a query.  With more queries there are more blocks and fewer groups,
so partial results stay in proportion to the queries.

Components are floor(scale * x) with x as double; scores are exact integers.
Products that could pass 2**53 are taken in exact (slower) whole numbers, and
scores beyond 64 bits become the nearest 64-bit number.

Defined results for odd input: a null id, a null vector, or one with a null or
non-finite component takes no part; vectors of unequal length meet as if the
shorter ended in zeros; an empty vector scores 0; rows that repeat are
candidates as often as they occur, and one query; of a query's own id no row is
its candidate; where one id has several vectors, the smallest in order is the
query; extra columns are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.vectors import Best, matrix, rows_of, widened

SCALE, K = 1024, 10
#: Queries of a block (expected) that share a task, queries that meet a chunk at once, candidates of a chunk, dimensions of a step.
BLOCK, QUERIES, CHUNK, STEP = 32_768, 512, 8192, 16
#: Candidates that the first queries start with; of so many pairs one may live where pairs replace the matrix.
START, SPARSE = 64, 8
#: Tasks of all blocks together, for each core.
TASKS_A_CORE = 2
_EXACT = 2.0**53
_PACKED = ("ids", "dims", "kind", "payload")


def _packs(rows: DataFrame, scale: int) -> DataFrame:
    """(ids, dims, payload): chunks of candidates, each dimension's components side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                m = np.floor(scale * matrix(part.column(1))[0])
                whole = m.astype(np.int32) if np.abs(m).max(initial=0) < 2**31 else m
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                        pa.array([m.shape[1]], pa.int32()),
                        pa.array([whole.dtype.str]),
                        pa.array([np.ascontiguousarray(whole.T).tobytes()], pa.binary()),
                    ],
                    names=["ids", "dims", "kind", "payload"],
                )

    return rows.mapInArrow(run, "ids binary, dims int, kind string, payload binary")


def meet(best: Best, block: np.ndarray, q_ids: np.ndarray, chunk: np.ndarray, c_ids: np.ndarray) -> int:
    """Offer a chunk (dims x candidates) to a block of queries (queries x dims).

    Returns how many pairs were ruled out before all their dimensions were read.
    """
    dims = max(block.shape[1], chunk.shape[0])
    block = widened(block, dims)
    if chunk.shape[0] < dims:
        chunk = np.pad(chunk, ((0, dims - chunk.shape[0]), (0, 0)))
    if not len(block) or not len(c_ids):
        return 0
    if np.abs(block).max(initial=0) * np.abs(chunk).max(initial=0) * max(1, dims) >= _EXACT:
        _meet_wide(best, block, q_ids, chunk, c_ids)
        return 0
    order = np.argsort(-(block**2).sum(axis=0), kind="stable")
    block, chunk = block[:, order], chunk[order]
    q_left = np.column_stack((np.sqrt(np.cumsum((block**2)[:, ::-1], axis=1)[:, ::-1]), np.zeros(len(block))))
    c_left = np.vstack((np.sqrt(np.cumsum((chunk**2)[::-1], axis=0)[::-1]), np.zeros(len(c_ids)))) * (1 + 1e-9)
    # with few candidates seen most survive: as many new ones at a time as were seen, so about k a query do
    start, pruned = 0, 0
    while start < len(c_ids):
        end = min(len(c_ids), start + max(START, best.seen))
        pruned += _bounded(best, block, q_ids, chunk[:, start:end], c_ids[start:end], q_left, c_left[:, start:end])
        best.seen += end - start
        best.settle()
        start = end
    return pruned


def _bounded(best: Best, block: np.ndarray, q_ids: np.ndarray, chunk: np.ndarray, c_ids: np.ndarray, q_left: np.ndarray, c_left: np.ndarray) -> int:
    """Block by block of dimensions: first all pairs as a matrix, whose dead rows and columns are cut out; then, once most are dead, the pairs left."""
    dims = block.shape[1]
    floor = best.floor.astype(np.float64)
    rows, cols = np.arange(len(block)), np.arange(len(c_ids))
    partial = np.where(q_ids[:, None] == c_ids[None, :], -np.inf, 0.0)
    pruned, d = 0, 0
    while d < dims or d == 0:
        end = min(d + STEP, dims)
        partial += block[rows, d:end] @ chunk[d:end, cols]
        d = end
        bound = q_left[rows, d][:, None] * c_left[d, cols][None, :]
        bound += partial
        alive = bound >= floor[rows][:, None]
        if d == dims:
            break
        n = int(np.count_nonzero(alive))
        if n * SPARSE <= alive.size:
            r, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if n * SPARSE <= len(r) * len(c):
                return pruned + _pairs(best, block, chunk, c_ids, q_left, c_left, floor, rows, cols, partial, alive, d) + alive.size - n
            pruned += alive.size - len(r) * len(c)
            rows, cols, partial = rows[r], cols[c], partial[np.ix_(r, c)]
    r, c = np.nonzero(alive & (partial > -np.inf))
    best.offer(rows[r], c_ids[cols[c]], partial[r, c].astype(np.int64))
    return pruned


def _pairs(best: Best, block, chunk, c_ids, q_left, c_left, floor, rows, cols, partial, alive, d: int) -> int:
    """The rest of the dimensions for the surviving pairs only, compacted after every block."""
    r, c = np.nonzero(alive)
    qi, ci, score, pruned = rows[r], cols[c], partial[r, c], 0
    dims = block.shape[1]
    while d < dims and len(qi):
        end = min(d + STEP, dims)
        score = np.concatenate([score[s : s + 65536] + np.einsum("id,di->i", block[qi[s : s + 65536], d:end], chunk[d:end, ci[s : s + 65536]]) for s in range(0, len(qi), 65536)])
        stay = score + q_left[qi, end] * c_left[end, ci] >= floor[qi]
        pruned += int((~stay).sum()) if end < dims else 0
        qi, ci, score, d = qi[stay], ci[stay], score[stay], end
    best.offer(qi, c_ids[ci], score.astype(np.int64))
    return pruned


def _meet_wide(best: Best, block: np.ndarray, q_ids: np.ndarray, chunk: np.ndarray, c_ids: np.ndarray) -> None:
    """Any components, in Python's whole numbers."""
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    b, c = whole(block), whole(chunk)
    for i in range(len(b)):
        score = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in b[i] @ c], np.int64)
        ok = np.flatnonzero((c_ids != q_ids[i]) & (score >= best.floor[i]))
        best.offer(np.full(len(ok), i), c_ids[ok], score[ok])


def top_k(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of each row where ``queries`` holds, over all rows."""
    spark = df.sparkSession
    rows = rows_of(df, key, vector)
    asked = rows_of(df.where(queries), key, vector).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // BLOCK))
    groups = max(1, -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // blocks))
    # queries are packed by their block, then sent to all its groups; candidates by theirs, to all blocks
    ask = _packs(asked.repartitionById(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), scale).withColumn("block", F.spark_partition_id())
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ask = ask.select("block", each(groups).alias("grp"), F.lit(0).alias("role"), *_PACKED)
    give = _packs(rows, scale).select(each(blocks).alias("block"), F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("grp"), F.lit(1).alias("role"), *_PACKED)
    # one partition for each block and group: a hash could put several in one and leave others empty
    met = ask.unionByName(give).repartitionById(blocks * groups, F.col("block") * groups + F.col("grp")).sortWithinPartitions("block", "grp", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packs, parts = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            for q_ids, _, best in parts:
                q, c, s = best.result()
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["grp"]) != at:
                    yield from out()
                    at, packs, parts = (row["block"], row["grp"]), [], []
                ids = np.frombuffer(row["ids"], np.int64)
                own = np.frombuffer(row["payload"], np.dtype(row["kind"])).reshape(row["dims"], len(ids)).astype(np.float64)
                if row["role"] == 0:
                    packs.append((ids, own.T))
                    continue
                if packs:  # all queries of the block are here: so many at a time meet each chunk
                    for q_ids, m in packs:
                        for s in range(0, len(q_ids), QUERIES):
                            part = q_ids[s : s + QUERIES]
                            parts.append((part, m[s : s + QUERIES], Best(len(part), k, np.int64, np.iinfo(np.int64).min)))
                    packs = []
                for q_ids, m, best in parts:
                    meet(best, m, q_ids, own, ids)
        yield from out()

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = K, scale: int = SCALE) -> str:
    """top_k over embeddings, queries divisible by 100, in DuckDB SQL."""
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {k}"""
