"""Approximate nearest neighbours: a forest of random-projection trees.

Nearness is the largest inner product.  Vectors are put on a sphere by one more
component, sqrt(M**2 - |x|**2) with M the largest norm, and queries by a zero:
then nearness is closeness, whatever the norms are.

* Trees are fitted on a bounded sample (``SAMPLE`` vectors by hash, at most
  ``SAMPLE_BYTES``; ``MODEL_BYTES`` for all hyperplanes): every node splits its
  sample at the median along a random direction.  The trees share their top
  levels, which divide the space into cells of about ``CELL`` vectors (one cell,
  so nothing shared, for a small table).  Every vector is put in one leaf of
  each tree, and all these leaves lie in its cell.
* A query searches all trees through one priority queue, ordered by the sum of
  squared distances to the hyperplanes that a node is on the wrong side of.  The
  queue is emptied level by level for many queries at once: of all trees' open
  nodes the ``most`` cheapest stay.  No node costs less than its parent and each
  has a leaf that costs the same, so these hold the first ``most`` leaves that a
  heap would give; hyperplanes off their paths aren't computed.
* How many leaves a query takes is calibrated, not guessed: for up to
  ``CALIBRATION`` queries the true neighbours in the sample are found, and the
  smallest number of leaves that finds ``TARGET`` of them is taken for all.  Of
  a table larger than the sample, that of the true neighbours is taken which the
  sample is expected to hold.
* Candidates of the leaves are ranked by their exact inner products of the
  original vectors.  A vector is sent once, to its cell; a query once to each
  cell that it visits, with its leaves there.  Where there are fewer cells than
  tasks, the vectors of a cell are salted over several.

Vectors that are equal form one class, whose smallest id is the candidate; of
its ids the k + 1 smallest come back (of equal scores only those can be among
the k nearest).  The forest is broadcast, bounded by ``MODEL_BYTES``.

Defined results for odd input: a null id, a null, empty or zero vector, or one
with a null or non-finite component takes no part; rows that repeat count once;
of a query's own id no row is its candidate; vectors shorter than the longest
end in zeros; with fewer candidates than k all are returned; extra columns are
left alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import seeded, written
from tessella.llm.vectors import matrix, rows_of, widened

K = 20
TREES, LEAF = 16, 32
SAMPLE, SAMPLE_BYTES, MODEL_BYTES = 50_000, 64_000_000, 64_000_000
CALIBRATION, TARGET = 200, 0.95
#: Sample vectors that a leaf holds at least, in the fit.
FILL = 8
#: Vectors of a cell, about; queries that a task takes at once.
CELL, QUERIES = 200_000, 256


class Forest:
    """Trees in heap order: node i has the children 2i and 2i+1; leaves are numbered from 0.

    The first ``cells`` - 1 nodes are the same in all trees.
    """

    def __init__(self, dims: int, top: float, leaves: int, cells: int, normals: np.ndarray, cuts: np.ndarray) -> None:
        self.dims, self.top, self.leaves, self.cells, self.normals, self.cuts = dims, top, leaves, cells, normals, cuts

    @classmethod
    def fit(cls, sample: np.ndarray, top: float, rows: int) -> Forest:
        dims = sample.shape[1]
        most = min(max(1, rows // LEAF), max(1, len(sample) // FILL), max(1, MODEL_BYTES // (4 * TREES * (dims + 2))))
        leaves = 1 << (most.bit_length() - 1)
        cells = min(leaves, 1 << max(0, (rows // CELL).bit_length()) if rows >= CELL else 1)
        rng = np.random.default_rng(seeded("forest", dims, leaves))
        normals = rng.standard_normal((TREES, leaves, dims + 1)).astype(np.float32)
        normals /= np.linalg.norm(normals, axis=2, keepdims=True)
        normals[:, :cells] = normals[:1, :cells]
        self = cls(dims, top, leaves, cells, normals, np.zeros((TREES, leaves), np.float32))
        raised = self.raised(sample[: 2 * FILL * leaves])
        for t in range(TREES):
            node = np.ones(len(raised), np.int64)
            level = 1
            while level < leaves:
                along = self._along(raised, t, node)
                order = np.lexsort((along, node))
                edge = np.searchsorted(node[order], np.arange(level, 2 * level + 1))
                some = np.flatnonzero(np.diff(edge))
                self.cuts[t, level + some] = along[order[(edge[some] + edge[some + 1]) // 2]]
                node = 2 * node + (along >= self.cuts[t, node])
                level *= 2
        return self

    def raised(self, m: np.ndarray, query: bool = False) -> np.ndarray:
        m = widened(m, self.dims)
        last = np.zeros(len(m)) if query else np.sqrt(np.maximum(0, self.top**2 - (m**2).sum(axis=1)))
        return np.column_stack((m, last)).astype(np.float32)

    def _along(self, raised: np.ndarray, t: int, node: np.ndarray) -> np.ndarray:
        """Each row's place along the normal of its node; all rows' nodes are of one level."""
        level = 1 << (int(node[0]).bit_length() - 1) if len(node) else 1
        if level <= 32:
            return (raised @ self.normals[t, level : 2 * level].T)[np.arange(len(node)), node - level]
        return np.concatenate([np.einsum("ij,ij->i", raised[s : s + 8192], self.normals[t, node[s : s + 8192]]) for s in range(0, len(raised), 8192)])

    def leaf(self, m: np.ndarray) -> np.ndarray:
        """(rows, TREES): the leaf of each vector in each tree."""
        raised, out = self.raised(m), np.empty((len(m), TREES), np.int32)
        for t in range(TREES):
            node = np.ones(len(m), np.int64)
            while len(node) and node[0] < self.leaves:
                node = 2 * node + (self._along(raised, t, node) >= self.cuts[t, node])
            out[:, t] = node - self.leaves
        return out

    def cell(self, leaf: np.ndarray) -> np.ndarray:
        """The cell of a leaf, of whichever tree."""
        return leaf // (self.leaves // self.cells)

    def search(self, m: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """For each query the first leaves (tree * leaves + leaf), cheapest first, by the shared priority queue."""
        flat, cuts, width = self.normals.reshape(-1, self.dims + 1), self.cuts.ravel(), self.leaves
        step = max(1, min(256, 8_000_000 // (max(1, min(most, TREES * width)) * (self.dims + 1))))
        raised = self.raised(m, query=True)
        for s in range(0, len(m), step):
            q = raised[s : s + step]
            tree = np.repeat(np.arange(TREES, dtype=np.int64)[None] * width, len(q), axis=0)
            node, cost, level = np.ones_like(tree), np.zeros(tree.shape), 1
            while level < width:
                at = tree + node
                if 2 * node.shape[1] >= TREES * level:  # most of the level is open
                    of = (np.arange(TREES)[:, None] * width + np.arange(level, 2 * level)).ravel()
                    along = np.take_along_axis(q @ flat[of].T, tree // width * level + node - level, axis=1)
                else:
                    along = np.matmul(flat[at], q[:, :, None])[:, :, 0]
                gap = along.astype(np.float64) - cuts[at]
                right = gap >= 0
                tree = np.concatenate((tree, tree), axis=1)
                node = np.concatenate((2 * node + right, 2 * node + ~right), axis=1)
                cost = np.concatenate((cost, cost + gap**2), axis=1)
                level *= 2
                if cost.shape[1] > most:
                    keep = np.argpartition(cost, most - 1, axis=1)[:, :most]
                    tree, node, cost = (np.take_along_axis(x, keep, axis=1) for x in (tree, node, cost))
            order = np.argsort(cost, axis=1, kind="stable")[:, :most]
            yield from np.take_along_axis(tree + node - width, order, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, added from the first component to the last.

    In that order a pair has the same score in whatever batch it is computed.
    """
    out = np.zeros(len(a))
    for d in range(min(a.shape[1], b.shape[1])):
        out += a[:, d] * b[:, d]
    return out


def calibrated(forest: Forest, sample: np.ndarray, asked: np.ndarray, k: int, share: float) -> int:
    """How many leaves find TARGET of the true neighbours that the sample (this share of all rows) holds."""
    total = TREES * forest.leaves
    if forest.leaves == 1 or not len(asked) or len(sample) < 2:
        return total
    dims = max(asked.shape[1], sample.shape[1])
    asked, sample = widened(asked, dims), widened(sample, dims)
    s = asked @ sample.T
    s[(asked[:, None, :1] == sample[None, :, :1]).all(axis=2) & (s >= (asked**2).sum(axis=1)[:, None] * (1 - 1e-9))] = -np.inf  # the query itself
    near = min(max(1, round(k * share)), len(sample) - 1)
    true = np.argpartition(-s, near - 1, axis=1)[:, :near]
    at = forest.leaf(sample[true.ravel()]).reshape(*true.shape, TREES) + np.arange(TREES) * forest.leaves
    rank, first = np.empty(total, np.int64), np.empty(true.shape, np.int64)
    for i, order in enumerate(forest.search(asked, total)):
        rank[order] = np.arange(total)
        first[i] = rank[at[i]].min(axis=1)
    first = np.sort(first.ravel())
    return int(first[min(len(first) - 1, int(np.ceil(TARGET * len(first))) - 1)]) + 1


class Block:
    """The vectors of a task, listed by the leaves they are in."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        flat = leaves.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows = order // max(1, leaves.shape[1])
        self.starts = np.searchsorted(flat[order], np.arange(int(flat.max(initial=-1)) + 2))
        self.compared = 0  # vectors that queries met, for reports

    def candidates(self, leaves: np.ndarray) -> np.ndarray:
        """The rows in any of these leaves, once each."""
        leaves = leaves[leaves < len(self.starts) - 1]
        start = self.starts[leaves]
        count = self.starts[leaves + 1] - start
        place = np.cumsum(count) - count
        rows = self.rows[np.repeat(start - place, count) + np.arange(int(count.sum()))]
        if len(rows) * 16 < len(self.ids):
            return np.unique(rows)
        there = np.zeros(len(self.ids), bool)
        there[rows] = True
        return np.flatnonzero(there)

    def best(self, q_ids: np.ndarray, queries: np.ndarray, leaves: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, row, score) of the k best candidates of each query."""
        dims = max(queries.shape[1], self.vectors.shape[1])
        queries, vectors = widened(queries, dims), widened(self.vectors, dims)
        who, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, own in enumerate(leaves):
            found = self.candidates(own)
            found = found[self.ids[found] != q_ids[i]]
            self.compared += len(found)
            if len(found) > k:
                s = vectors[found] @ queries[i]
                least = np.partition(s, len(s) - k)[len(s) - k]
                found = found[s >= least - 1e-9 * max(1.0, abs(least))]  # rounding may differ from that of the score
            who.append(np.full(len(found), i))
            rows.append(found)
        who, rows = np.concatenate(who), np.concatenate(rows)
        score = _products(queries[who], vectors[rows])
        order = np.lexsort((self.ids[rows], -score, who))
        who, rows, score = who[order], rows[order], score[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        return who[keep], rows[keep], score[keep]


def _classes(rows: DataFrame) -> DataFrame:
    """(cid, copies, v): each different vector with its smallest id and its number of ids."""
    return rows.groupBy("v").agg(F.min("id").alias("cid"), F.count("*").alias("copies")).select("cid", "copies", "v")


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row where ``queries`` holds, over all rows."""
    spark = df.sparkSession
    not_zero = F.exists("v", lambda x: x != 0)
    rows = rows_of(df, key, vector).where(not_zero)
    classes = written(_classes(rows), "classes")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = classes.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("dims"), F.max("copies").alias("copies")).first()
    if not stats["n"]:
        return classes.select(F.col("cid").alias("query_id"), F.lit(1).alias("rank"), F.col("cid").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    several = stats["copies"] > 1
    asked = rows_of(df.where(queries), key, vector).where(not_zero)
    if several:
        asked = written(asked.distinct().join(classes.select("cid", "v"), "v").select("id", "cid", "v"), "asked")
        each = asked.groupBy("cid").agg(F.first("v").alias("v"))
    else:
        asked = asked.select("id", F.col("id").alias("cid"), "v")
        each = asked.select("cid", "v")
    take = min(SAMPLE, max(1000, SAMPLE_BYTES // (8 * stats["dims"])))
    share = min(1.0, take / stats["n"])
    hashed = F.pmod(F.xxhash64(F.lit("sample"), "cid"), F.lit(1 << 30))
    sample = classes.where(hashed < int(share * (1 << 30)) + 1).select("v").limit(2 * take)
    sample = widened(matrix(sample.toArrow().column(0).combine_chunks())[0], stats["dims"])
    forest = Forest.fit(sample, stats["top"], stats["n"])
    some = each.orderBy(F.xxhash64(F.lit("calibrate"), "cid")).limit(CALIBRATION).select("v").toArrow().column(0).combine_chunks()
    most = calibrated(forest, sample, matrix(some)[0], k, share) if len(some) else 1
    shared = spark.sparkContext.broadcast(forest)

    salts = max(1, -(-spark.sparkContext.defaultParallelism // forest.cells))
    offsets = np.arange(TREES) * forest.leaves

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors with their leaves in all trees, in their cell's task."""
        forest = shared.value
        for batch in batches:
            m, cid = matrix(batch.column("v"))[0], batch.column("cid").to_numpy()
            leaf = forest.leaf(m)
            salt = (cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(salts)
            task = forest.cell(leaf[:, 0]) * salts + salt.astype(np.int64)
            yield _packed(task, 0, cid, batch.column("v"), leaf + offsets)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the leaves they visit, for each task of the cells of these."""
        forest = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, QUERIES):
                part = batch.slice(s, QUERIES)
                row, task, lists = [], [], []
                for i, leaves in enumerate(forest.search(matrix(part.column("v"))[0], most)):
                    cell = forest.cell(leaves % forest.leaves)
                    order = np.argsort(cell, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                        at = int(cell[own[0]])
                        row += [i] * salts
                        task += range(at * salts, (at + 1) * salts)
                        lists += [leaves[own]] * salts
                take = part.take(pa.array(row, pa.int32()))
                yield _packed(np.array(task, np.int64), 1, take.column("cid").to_numpy(), take.column("v"), lists)

    kind = "task int, role int, cid long, v array<double>, leaves array<int>"
    met = each.mapInArrow(visit, kind).unionByName(classes.select("cid", "v").mapInArrow(place, kind))
    met = met.repartitionById(forest.cells * salts, F.col("task")).sortWithinPartitions("role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors first; then queries, so many at a time."""
        held, block = [], None
        for batch in batches:
            role = batch.column("role").to_numpy()
            cut = int(np.searchsorted(role, 1))
            if cut:
                held.append(batch.slice(0, cut))
            for s in range(cut, batch.num_rows, QUERIES):
                if block is None:
                    if not held:
                        return
                    v = matrix(pa.chunked_array([b.column("v") for b in held]).combine_chunks())[0]
                    block = Block(np.concatenate([b.column("cid").to_numpy() for b in held]), v, np.concatenate([matrix(b.column("leaves"))[0] for b in held]).astype(np.int64))
                    held = []
                part = batch.slice(s, QUERIES)
                ids, lists = part.column("cid").to_numpy(), part.column("leaves")
                ends = lists.offsets.to_numpy()
                own = np.split(lists.values.to_numpy()[ends[0] : ends[-1]], (ends[1:-1] - ends[0]))
                q, c, score = block.best(ids, matrix(part.column("v"))[0], own, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(block.ids[c], pa.int64()), pa.array(score, pa.float64())], names=["q", "cid", "score"])

    found = met.mapInArrow(run, "q long, cid long, score double")
    order = W.partitionBy("q").orderBy(F.desc("score"), "cid")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if not several:
        return found.select(F.col("q").alias("query_id"), "rank", F.col("cid").alias("vec_id"), "score")
    # back from classes to rows: copies of a candidate, and of the query itself
    first = W.partitionBy("cid").orderBy("id")
    ids = rows.distinct().join(classes.where("copies > 1").select("cid", "v"), "v").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    ids = ids.groupBy("cid").agg(F.collect_list("id").alias("ids"))  # k + 1 at most
    found = found.select("q", "cid", "score").join(ids, "cid", "left").select("q", F.coalesce("ids", F.array("cid")).alias("ids"), "score")
    own = classes.where("copies > 1").select(F.col("cid").alias("q"), "v").mapInArrow(_own_scores, "q long, score double")
    own = own.join(ids.withColumnRenamed("cid", "q"), "q").select("q", "ids", "score")
    pairs = asked.select("id", F.col("cid").alias("q")).join(found.unionByName(own), "q").select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    final = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(task: np.ndarray, role: int, cid: np.ndarray, v: pa.Array, leaves) -> pa.RecordBatch:
    lists = [*leaves]
    ends = np.cumsum([0, *map(len, lists)])
    flat = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(task.astype(np.int32)), pa.array(np.full(len(task), role, np.int32)), pa.array(cid, pa.int64()), v, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
        names=["task", "role", "cid", "v", "leaves"],
    )


def _own_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class of copies with itself."""
    for batch in batches:
        m = matrix(batch.column("v"))[0]
        yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array(_products(m, m), pa.float64())], names=["q", "score"])
