"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles (64-bit hashes of the words,
A-Z in lower case).  A SetSketch register is the smallest of the set's
pseudo-random exponential values, kept on an exponential scale of base ``B``
and cut off at both ends; registers of a union are the maxima of the parts'
registers.  Documents with a Jaccard similarity J agree in a register with a
probability of J or slightly more, so bands of registers serve as join keys.

1. Documents with equal sets form a class; all else works on one row a class.
2. Every band of a class is a key; classes that share a key are tied to the
   smallest class of that key (a star, not all pairs).
3. Pairs whose joint likelihood, given both set sizes and the registers, peaks
   far below the threshold are dropped; the others are confirmed on the full
   sets, and the connected components found.
4. In keys that still hold classes of different components, the pairs across
   components are compared by their registers (each in the first band that it
   shares), those above the likelihood bound confirmed on the full sets, and
   the components found again.  A key of more than ``BLOCK`` classes meets in
   blocks of that size, two in a task, with the same test; what such a task
   returns are the likely pairs only.

After 4 every candidate pair is either confirmed, refuted or inside one
component, so no group is ever spelled out as pairs, however large it is.

A pair at the threshold of 0.7 is missed with a probability of 1.5e-6 (32 bands
of 3), whatever the size of its keys; pairs above it more rarely.

A text is found again by a hash of its doc_id and text (96 bits), so rows with a
null or shared doc_id don't multiply; rows that repeat exactly are one.

Defined results for odd input: a null text, or one without words, has an empty
set and is linked with nothing; with fewer than 5 words the whole sequence is
the one shingle; a null doc_id counts as larger than all others; rows that
repeat are members of one class, and each comes back; extra columns are left
alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import forgotten, frugal, parts, seeded, written

WORDS, PERCENT = 5, 70
BANDS, ROWS = 32, 3
M = BANDS * ROWS
#: Base, rate and largest register of the exponential scale.
B, A, Q = 1.001, 20.0, 65534
#: Pairs whose most likely similarity is below this are not confirmed: over 5 standard deviations below the threshold.
LIKELY = 0.45
#: Classes of a block; a key of more meets block by block.
BLOCK = 2048
#: Pairs compared at once.
PAIRS, LIKELY_AT_ONCE = 20_000, 512
#: Members of a pivot that one task confirms in a row; larger stars are salted.
STAR = 1000
#: Numbers to which wanted documents are hashed, for a list that is broadcast (8 MB at most).
RESIDUES = 1 << 20
#: The list of duplicates to drop is broadcast up to so many rows (about 5 MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 50_000

_rng = np.random.default_rng(seeded("setsketch", 1))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(int(_rng.integers(0, 2**63)) * 2 + 1)
_PLACE = _rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = (_rng.integers(0, 2**31, M, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_HIGH = (_rng.integers(0, 2**31, M, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, M, np.uint64).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << n.bit_length()
        back = np.uint64(pow(int(_BASE), -1, 2**64))
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, _BASE))))
        _inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, back))))
    return _powers, _inverse


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and each text's number of words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = _BLANK[flat]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    powers, inverse = _power_tables(len(flat) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[flat] * powers[: len(flat)])))
    words = mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(b) + 1 for b in raw])
    return words, np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    n = max(0, len(words) - WORDS + 1)
    all_ = np.zeros(n, np.uint64)
    for k in range(WORDS):
        all_ += mixed(words[k : n + k] + _PLACE[k]) * _PLACE[k]
    all_ = mixed(all_)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WORDS:
            out.append(np.unique(all_[at : at + c - WORDS + 1]))
        elif c:
            out.append(mixed((words[at : at + c] * _PLACE[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits by which equal sets are told."""
    one = int(mixed(shingles + np.uint64(0x51ED27)).sum(dtype=np.uint64))
    two = int(np.bitwise_xor.reduce(mixed(shingles * np.uint64(3) + np.uint64(len(shingles)))))
    return one - 2**63, two - 2**63


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), M) uint16 registers of sets that aren't empty."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    least = np.empty((M, len(sets)), np.uint32)
    for i in range(M):
        least[i] = np.minimum.reduceat(low * _LOW[i] + high * _HIGH[i] + _ADD[i], first)
    exponential = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential / A) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, m: int = M, steps: int = 200) -> np.ndarray:
    """The Jaccard similarity of greatest joint likelihood.

    Given both set sizes and in how many of m registers a is above, and below, b.
    """
    if len(n_a) > LIKELY_AT_ONCE:  # a row takes some 20 kB
        cuts = range(0, len(n_a), LIKELY_AT_ONCE)
        return np.concatenate([likely_similarity(*(x[c : c + LIKELY_AT_ONCE] for x in (n_a, n_b, above, below)), m, steps) for c in cuts])
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = most * np.linspace(0, 1, steps + 1)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    more, less = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda k, q: np.where(k[:, None] > 0, k[:, None] * np.log(np.maximum(q, 1e-300)), 0.0)
        score = term(above, more) + term(below, less) + term(m - above - below, 1 - more - less)
    return j[np.arange(len(j)), np.argmax(score, axis=1)]


# -- step 1 ------------------------------------------------------------------------------


def _told(docs: DataFrame) -> DataFrame:
    """docs with rid and rid2, by which a row's text is found again."""
    text = F.col("text").cast("string")
    return docs.withColumns({"rid": F.xxhash64(F.col("doc_id").cast("long"), text), "rid2": F.hash(text)})


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, rid2, n_shingles, c1, c2, registers) of every row; registers null for an empty set."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 3, 250_000):
                sets = shingle_sets(part.column(3).to_pylist())
                full = [s for s in sets if len(s)]
                regs = (r.tobytes() for r in registers(full)) if full else iter(())
                keys = [class_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([next(regs) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "rid", "rid2", "n_shingles", "c1", "c2", "registers"],
                )

    columns = _told(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "rid", "rid2", F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, rid long, rid2 int, n_shingles long, c1 long, c2 long, registers binary")


def classes_of(sketched: DataFrame) -> DataFrame:
    """(node, c1, c2, first, n, registers): one row for each set that isn't empty.  Written, so that node stays.

    first: the class's row with the smallest doc_id, as (none, doc_id, rid, rid2).
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rid2"))
    rows = sketched.where("n_shingles > 0").groupBy("c1", "c2").agg(first.alias("first"), F.max("n_shingles").alias("n"), F.first("registers").alias("registers"))
    return written(rows.withColumn("node", F.monotonically_increasing_id()), "classes")


# -- steps 2 and 4: candidates -------------------------------------------------------------


def _band_keys() -> Column:
    at = F.col("registers")
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(at, i * width + 1, F.lit(width))))


def band_rows(classes: DataFrame) -> DataFrame:
    return classes.select("node", F.explode(_band_keys()).alias("key"))


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): every class with the smallest class that shares a band with it."""
    rows = band_rows(classes)
    tops = rows.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1").select("key", "a")
    return rows.join(tops, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _sides(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    # sets of too different sizes can't reach the threshold
    near = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near)


def _as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), M)


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose likelihood doesn't rule the threshold out."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x, y = _as_registers(part.column("r_a")), _as_registers(part.column("r_b"))
                above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
                j = likely_similarity(part.column("n_a").to_numpy().astype(float), part.column("n_b").to_numpy().astype(float), above, below)
                yield part.select(["a", "b"]).filter(pa.array(j >= LIKELY))

    return _sides(pairs, classes).select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def cross_pairs(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of different components that share a band and aren't ruled out by likelihood, each once.

    roots: (node, comp) of the classes in components of more than one.
    """
    spark = classes.sparkSession
    comp = classes.join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("node", "comp", "n", "registers")
    rows = comp.select("node", "comp", F.posexplode(_band_keys()).alias("band", "key"))
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    open_ = rows.join(several.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "key")
    # block i of a key against block j, i <= j; a key of one block is block 0 against itself
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "node", "comp")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    members = meets.join(comp.select("node", "n", "registers"), "node").repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "own")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) < 2 * BLOCK:
                continue
            table = pa.Table.from_batches(rest).combine_chunks()
            where = [table[c].to_numpy() for c in ("key", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([w != w[-1] for w in where]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield from _compared(table.slice(0, cut))
            rest = table.slice(cut).to_batches()
        if rest:
            yield from _compared(pa.Table.from_batches(rest).combine_chunks())

    return members.mapInArrow(run, "a long, b long")


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Likely pairs of whole groups (key, i, j), whose rows follow each other sorted by own."""
    key, i, j, own, band, node, root, n = (table[c].to_numpy() for c in ("key", "i", "j", "own", "band", "node", "comp", "n"))
    regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(len(node), M)
    size = len(node)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    end = np.append(np.flatnonzero(new)[1:], size)[np.cumsum(new) - 1]
    count = end - np.arange(size) - 1  # partners after a row
    count[(i != j) & (own == j)] = 0  # two blocks: only those of the first meet those of the second
    total = np.cumsum(count)
    at = 0
    while at < size:
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        left = np.repeat(np.arange(at, stop), count[at:stop])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count[at:stop]) - count[at:stop], count[at:stop])
        ok = (root[left] != root[right]) & ((i[left] == j[left]) | (own[left] != own[right])) & (np.minimum(n[left], n[right]) * 100 >= np.maximum(n[left], n[right]) * PERCENT)
        left, right = left[ok], right[ok]
        a, b = regs[left], regs[right]
        same = a == b
        ok = same.sum(axis=1) >= LIKELY * 0.7 * M
        ok &= same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[left]  # elsewhere they met before
        left, right, a, b = left[ok], right[ok], a[ok], b[ok]
        if len(left):
            likely = likely_similarity(n[left].astype(float), n[right].astype(float), (a > b).sum(axis=1), (a < b).sum(axis=1)) >= LIKELY
            x, y = node[left[likely]], node[right[likely]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
        at = stop


# -- step 3: confirmation on the full sets ---------------------------------------------------


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold.

    The texts of a pair's pivot a and of its members meet in one sorted stream:
    the pivot's set is made once, then compared with one member after another.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    pivots = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    wanted = members.unionByName(pivots).join(classes.select("node", F.col("first.rid").alias("rid"), F.col("first.rid2").alias("rid2"), "c1", "c2"), "node")
    wanted = written(wanted, "wanted")
    texts = _told(docs.select("doc_id", "text")).select("rid", "rid2", F.col("text").cast("string").alias("text"))
    # most texts that nothing asks for go before the shuffle, by a list of at most RESIDUES numbers; rows that
    # repeat are combined before it, and the join uses it
    residue = F.pmod("rid", F.lit(RESIDUES))
    texts = texts.join(F.broadcast(wanted.select(residue.alias("__m")).distinct()), residue == F.col("__m"), "left_semi").dropDuplicates(["rid", "rid2"])
    met = texts.join(wanted, ["rid", "rid2"]).select("a", "salt", "role", "node", "c1", "c2", "text")
    met = met.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot_of, pivot = None, np.empty(0, np.uint64)
        for batch in batches:
            for part in parts(batch, 6, 250_000):
                a_out, b_out = [], []
                rows = part.to_pydict()
                for i, own in enumerate(shingle_sets(rows["text"])):
                    if class_key(own) != (rows["c1"][i], rows["c2"][i]):
                        continue  # another text with the same hashes
                    group = (rows["a"][i], rows["salt"][i])
                    if rows["role"][i] == 0:
                        pivot_of, pivot = group, own
                    elif group == pivot_of:
                        both = len(np.intersect1d(pivot, own, assume_unique=True))
                        if both * 100 >= PERCENT * (len(pivot) + len(own) - both):
                            a_out.append(group[0])
                            b_out.append(rows["node"][i])
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


# -- components ------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); comp: the smallest node reachable.

    Alternating large-star and small-star steps; every step's edges are written.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while True:  # some log(nodes) ** 2 rounds at most
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e, old = written(small.where("u <> v").distinct(), "edges"), e
        forgotten(old)
        new = _state(e)
        if new == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = new


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)


def _resolved(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, rid2, n_shingles, component_id, stays) of every row; stays: it is (or repeats) the one row of its component that stays."""
    sketched = written(sketches(docs), "sketches")
    classes = classes_of(sketched)
    stars = written(likely_pairs(star_pairs(classes), classes), "pairs")
    links = written(confirmed(stars, classes, docs), "links")
    roots = components(links)
    across = written(cross_pairs(classes, roots), "pairs")
    more = written(confirmed(across, classes, docs), "links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    forgotten(stars, links, across, more)
    named = classes.select("node", "c1", "c2", "first").join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = named.join(named.groupBy("comp").agg(F.min("first").alias("w")), "comp").select("c1", "c2", "w")
    plain = sketched.select("doc_id", "rid", "rid2", "n_shingles", "c1", "c2")
    stays = (F.col("rid") == F.col("w.rid")) & (F.col("rid2") == F.col("w.rid2"))
    full = plain.where("n_shingles > 0").join(named, ["c1", "c2"]).withColumns({"component_id": F.col("w.doc_id"), "stays": stays}).drop("w")
    empty = plain.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "stays": F.lit(True)})
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    return _resolved(docs).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, without near duplicates: of each component one row with the smallest doc_id.

    Rows with an empty set are linked with nothing and stay.  Of rows that
    repeat exactly one stays.
    """
    found = written(_resolved(docs), "resolved")
    ids = found.groupBy(F.col("rid").alias("__rid"), F.col("rid2").alias("__rid2")).agg(F.min("stays").alias("__stays"), (F.max("n_shingles") > 0).alias("__full"), F.count("*").alias("__n"))
    again = F.col("__stays") & F.col("__full") & (F.col("__n") > 1)
    odd = written(ids.where(~F.col("__stays") | again).select("__rid", "__rid2", again.alias("__again")), "ids")
    rows = _told(docs.select("doc_id", "text", *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]).withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in ("rid", "rid2")}))
    names = [c if c not in ("rid", "rid2") else f"__own_{c}" for c in docs.columns]
    on = (F.col("rid") == F.col("__rid")) & (F.col("rid2") == F.col("__rid2"))
    # what goes is less than what stays; up to a size it is broadcast, and no text is shuffled
    few = F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd
    out = rows.join(few.select("__rid", "__rid2"), on, "left_anti")
    once = rows.join(few.where("__again"), on, "left_semi").dropDuplicates(["rid", "rid2"])
    return out.unionByName(once).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def sql() -> str:
    """near_duplicates over documents in DuckDB SQL: all pairs that share a shingle, then what they reach."""
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when w is null or len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) end) as g from d),
n as (select doc_id, len(g) as n from s),
x as materialized (select doc_id, hash(unnest(g)) as h from s),
e as materialized (select p.a, p.b from (select y.doc_id as a, z.doc_id as b, count(*) as c from x y join x z on y.h = z.h and y.doc_id <> z.doc_id group by 1, 2) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where p.c * 100 >= {PERCENT} * (na.n + nb.n - p.c)),
r(a, b) as (select doc_id, doc_id from n union select r.a, e.b from r join e on e.a = r.b)
select n.doc_id, n.n::bigint as n_shingles, min(r.b) as component_id, n.doc_id = min(r.b) as kept from n join r on r.a = n.doc_id group by n.doc_id, n.n"""
