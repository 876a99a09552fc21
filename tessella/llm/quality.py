"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a few transformed statistics (logs of lengths, square roots
of shares of kinds of characters, shares of words and lines that repeat).  Each
class gets a mean and a covariance, shrunk towards the pooled covariance and
towards a multiple of the identity.  A score is the probability of label 1 that
follows from the difference of the log densities, whose Mahalanobis distances
use Cholesky factors made once when the model is fitted.

The fit needs the classes' sums of statistics and of their products only: they
are added up within every task and the few dozen numbers of each task once
more.  It takes at most about ``TRAIN_ROWS`` labelled documents (all, if fewer;
else a sample by hash of doc_id), so their list is broadcast and neither texts
nor statistics are shuffled.

Defined results for odd input: a null text is scored as an empty one; an empty
text has a score like any other; texts of any length are read whole; a null
doc_id is never held out and never trains; a doc_id that repeats in documents
trains once for every row, one that repeats in labels once for every different
label; null labels are left out;
extra columns are left alone; without any label of one class the score is the
share of label 1 (0.5 without any label); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import frugal, parts, written
from tessella.llm.setsketch import word_hashes

#: Weights of the pooled covariance and of the identity in a class's covariance.
POOLED, RIDGE = 0.1, 0.02
#: predicted is 1 from this score.
THRESHOLD = 0.3
#: One document in FOLDS is held out.
FOLDS = 5
#: Labelled documents that a model is trained on, about, at most.
TRAIN_ROWS = 100_000

_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": [ord(c) for c in ".,;:?"],
    "mark": [ord(c) for c in "!#$%&*+=@^_~<>{}[]/\\"],
    "bar": [ord("|")],
    "quote": [ord(c) for c in "'\"()-"],
    "blank": [32, *range(9, 14)],
    "line": [10],
    "high": range(128, 256),
}
_MASKS = np.zeros((256, len(_KINDS)))
for _i, _codes in enumerate(_KINDS.values()):
    _MASKS[list(_codes), _i] = 1
NAMES = ["log_bytes", "log_words", "log_word_bytes", *_KINDS, "repeated_words", "repeated_pairs"]
N = len(NAMES)
#: Bytes and words that a text counts as having besides its own, so that shares of a few words don't run to extremes.
MORE_BYTES, MORE_WORDS = 200, 40


def _repeats(keys: np.ndarray) -> int:
    """How many of the keys occurred before."""
    own = np.sort(keys)
    return int((own[1:] == own[:-1]).sum())


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, N) transformed statistics of whole texts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    kinds = np.array([np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in raw]).reshape(-1, 256) @ _MASKS
    words, counts = word_hashes(texts)
    repeats, at = np.zeros((len(texts), 2)), 0
    for i, c in enumerate(counts.tolist()):
        own = words[at : at + c]
        at += c
        if c > 1:
            repeats[i] = _repeats(own), _repeats(own[1:] * np.uint64(0x9E3779B97F4A7C15) + own[:-1])
    return np.column_stack(
        [
            np.log1p(sizes),
            np.log1p(counts),
            np.log1p(sizes / np.maximum(1, counts)),
            np.sqrt(kinds / (sizes + MORE_BYTES)[:, None]),
            np.sqrt(repeats / (counts + MORE_WORDS)[:, None]),
        ]
    )


def moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products for the classes 0 and 1."""
    parts = [x[y == c] for c in (0, 1)]
    return np.array([len(p) for p in parts], float), np.array([p.sum(axis=0) for p in parts]), np.array([p.T @ p for p in parts])


class Model:
    """Two classes, each with its mean, Cholesky factor and log weight."""

    def __init__(self, share: float, centre: np.ndarray, scale: np.ndarray, classes: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        self.share, self.centre, self.scale, self.classes = share, centre, scale, classes

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        out = []
        for mean, inverse, weight in self.classes:
            out.append(weight - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """A model from the counts, sums and sums of products of both classes."""
    total = n.sum()
    share = float(n[1] / total) if total else 0.5
    if not n.min():
        return Model(share, np.zeros(sums.shape[1]), np.ones(sums.shape[1]), [])
    centre = sums.sum(axis=0) / total
    spread = products.sum(axis=0) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    scale[scale < 1e-5] = 1.0
    means = (sums / n[:, None] - centre) / scale
    own = [(products[c] / n[c] - np.outer(sums[c], sums[c]) / n[c] ** 2) / np.outer(scale, scale) for c in (0, 1)]
    both = (own[0] * n[0] + own[1] * n[1]) / total
    classes = []
    for c in (0, 1):
        cov = (1 - pooled) * own[c] + pooled * both
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        classes.append((means[c], np.linalg.inv(factor), float(np.log(n[c] / total) - np.log(np.diag(factor)).sum())))
    return Model(share, centre, scale, classes)


# -- over DataFrames ---------------------------------------------------------------------


def held_out(doc_id: str | Column) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: its transformed statistics."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, 250_000):
                x = features(part.column(1).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _rows(column: pa.Array) -> np.ndarray:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].reshape(len(column), N)


def training_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that train: those not held out, all or about TRAIN_ROWS by hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def train(stats: DataFrame, known: DataFrame) -> Model:
    """A model from (doc_id, x) and training_rows."""
    rows = stats.join(F.broadcast(known), "doc_id").select("x", "y")
    return _trained(rows, lambda batch: [(_rows(batch.column(0)), batch.column(1).to_numpy())])


def train_on_texts(docs: DataFrame, known: DataFrame) -> Model:
    """A model from (doc_id, text) and training_rows.

    The labels meet the texts before Python sees them, so statistics and moments
    are made in one pass: a task never needs two Python workers at once.
    """
    labelled = known.select(F.col("doc_id").alias("__d"), F.col("y").alias("__y"))
    rows = docs.join(F.broadcast(labelled), F.col("doc_id").cast("long") == F.col("__d")).select(F.col("text").cast("string").alias("text"), "__y")
    return _trained(rows, lambda batch: ((features(p.column(0).to_pylist()), p.column(1).to_numpy()) for p in parts(batch, 0, 250_000)))


def _trained(rows: DataFrame, examples: Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """A model from the statistics and labels that examples gives for each batch of rows."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = np.zeros(2), np.zeros((2, N)), np.zeros((2, N, N))
        for batch in batches:
            for x, y in examples(batch):
                a, b, c = moments(x, y)
                n, s, p = n + a, s + b, p + c
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((n, s.ravel(), p.ravel())).tolist()], pa.list_(pa.float64()))], names=["m"])

    sums = [np.array(r["m"]) for r in rows.mapInArrow(run, "m array<double>").collect()]  # one small row a task
    all_ = reduce(np.add, sums, np.zeros(2 + 2 * N + 2 * N * N))
    return fit(all_[:2], all_[2 : 2 + 2 * N].reshape(2, N), all_[2 + 2 * N :].reshape(2, N, N))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Texts are read once; what is written, joined with the labels and read again
    is the statistics.
    """
    stats = written(statistics(docs), "statistics")
    model = train(stats, training_rows(labels))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole, whose score reaches the threshold.

    The model is fitted as in :func:`scores`, on the statistics of the training
    documents alone; the rows are then scored where they are scanned, so no text
    is shuffled.
    """
    known = training_rows(labels)
    model = train_on_texts(docs, known)
    at = docs.columns.index("text")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, at, 250_000):
                yield part.filter(pa.array(model.score(features(part.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
