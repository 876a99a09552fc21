"""Chat formatting with cumulative snapshots collapsed.

Logs often hold a conversation again and again, each time a few turns longer.
Such a snapshot, whose turns are the first turns of a longer conversation, is
dropped, and of equal conversations the one with the smallest id stays; the
others are rendered.

A turn's hash covers its role and text; the hash of the first i turns is a
polynomial of theirs (two of 64 bits, modulo 2**64), so hashes of stretches of
turns combine.  The whole of a conversation is a prefix of another where its
hash, with its number of turns, is among the other's prefix hashes: an
anti-join of one row per conversation against the distinct proper prefixes,
which are combined before they are shuffled, so a greeting that a third of all
conversations share is one row a task.

Turns are range-sorted by conversation and place, with hashes for their texts.
Places and prefix hashes run along each range; what a conversation has in
earlier ranges is added afterwards, from at most two rows a range.  So neither a
conversation with a third of all turns, nor one whose turns all have the same
number or none, gathers in one task.

Rendered text comes in parts of ``PART`` turns (nearly every conversation has
one part), so no conversation is put together in one task whatever its length;
parts in order, concatenated, are the whole.

Defined results for odd input: a turn that repeats exactly counts once; turns
with equal numbers follow by role, then text; turns without a number come last;
a null role is rendered as ``unknown`` and a null text as the empty text, but
both differ from those strings when turns are compared; rows with a null
conv_id form one conversation; extra columns are left alone; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import written

#: Turns of a part of the rendered text.
PART = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Bases of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _turn_key() -> Column:
    """A turn's role and text as one hash; nulls differ from empty strings."""
    part = lambda c: F.coalesce(F.concat(F.lit("1"), F.md5(F.col(c).cast("string"))), F.lit("0"))
    return F.unhex(F.md5(F.concat(part("role"), part("text"))))


def _turns(chats: DataFrame) -> DataFrame:
    own = chats.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.withColumn("key", _turn_key())


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv, turn, key, k1, k2) with range, place, h1, h2 within the range, and whether the next is of another conversation."""
    part = TaskContext.get().partitionId()
    at, count, sums, held = None, 0, [0, 0], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        none = batch.column("conv").is_null().to_numpy(zero_copy_only=False)
        conv = batch.column("conv").fill_null(0).to_numpy()
        new = np.concatenate(([at != (bool(none[0]), int(conv[0]))], (conv[1:] != conv[:-1]) | (none[1:] != none[:-1])))
        if held is not None:
            yield _flagged(held, np.array([new[0]]))
        if new[0]:
            count, sums = 0, [0, 0]
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        inside = np.arange(n) - begin + 1  # place in the batch's own stretch
        goes_on = (begin == 0) & ~new[0]
        place = inside + np.where(goes_on, count, 0)
        hashes = []
        for j, base in enumerate(BASES):
            power = _powers(base, n)[inside]
            power[goes_on] *= np.uint64(pow(base, count, 1 << 64))
            total = np.cumsum(batch.column(f"k{j + 1}").to_numpy().view(np.uint64) * power)
            before = np.concatenate(([np.uint64(0)], total))[begin]
            own = total - before
            own[goes_on] += np.uint64(sums[j])
            hashes.append(own)
        at, count, sums = (bool(none[-1]), int(conv[-1])), int(place[-1]), [int(h[-1]) for h in hashes]
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), *(batch.column(c) for c in ("conv", "turn", "key")), pa.array(place.astype(np.int64)), *(pa.array(h.view(np.int64)) for h in hashes)],
            names=["part", "conv", "turn", "key", "place", "h1", "h2"],
        )
        if n > 1:
            yield _flagged(out.slice(0, n - 1), new[1:])
        held = out.slice(n - 1)
    if held is not None:
        yield _flagged(held, np.array([True]))


def _flagged(batch: pa.RecordBatch, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(last.astype(bool))], names=[*batch.schema.names, "last"])


def prefixes(chats: DataFrame) -> DataFrame:
    """(conv, turn, key, place, h1, h2, last): every different turn with its place from 1, the hash of the turns up to it, and whether it ends its conversation.

    Hashes stand for the texts, which aren't shuffled here.
    """
    turns = _turns(chats).select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("role").isNotNull().alias("named"), "key").distinct()
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("named"), F.col("role"), F.col("key")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select("conv", "turn", "key", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("two"), "key").alias("k2"))
    local = written(ordered.mapInArrow(_along, "part int, conv long, turn long, key binary, place long, h1 long, h2 long, last boolean"), "chat-turns")
    # conversations in several ranges: at most one goes on into a range, so these are at most two rows a range
    ends = local.where("last").select("part", "conv", "place", "h1", "h2")
    ends = ends.withColumn("parts", F.count("*").over(W.partitionBy("conv"))).where("parts > 1").orderBy("part").collect()
    base, goes_on, so_far = {}, {}, {}
    for r in ends:
        n, sums = so_far.get(r.conv, (0, (0, 0)))
        powers = tuple(pow(b, n, 1 << 64) for b in BASES)
        if n:
            base[r.part] = (r.conv, n, sums, powers)
        so_far[r.conv] = n + r.place, tuple((s + p * (h & _ALL)) & _ALL for s, p, h in zip(sums, powers, (r.h1, r.h2)))
    final = {r.conv: r.part for r in ends}
    for r in ends:
        if r.part != final[r.conv]:
            goes_on[r.part] = r.conv
    if not ends:
        return local.drop("part")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, none = batch.column("part").to_numpy(), batch.column("conv").is_null().to_numpy(zero_copy_only=False)
            conv = batch.column("conv").fill_null(0).to_numpy()
            of = lambda p, c: (part == p) & (none if c is None else ~none & (conv == c))  # noqa: B023, E731
            place, last = batch.column("place").to_numpy().copy(), batch.column("last").to_numpy(zero_copy_only=False).copy()
            hashes = [batch.column(c).to_numpy().view(np.uint64).copy() for c in ("h1", "h2")]
            for p in np.unique(part).tolist():
                if p in base:
                    c, n, sums, powers = base[p]
                    rows = of(p, c)
                    place[rows] += n
                    for h, s, power in zip(hashes, sums, powers):
                        h[rows] = np.uint64(s) + np.uint64(power) * h[rows]
                if p in goes_on:
                    last[of(p, goes_on[p])] = False
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "turn", "key")), pa.array(place), *(pa.array(h.view(np.int64)) for h in hashes), pa.array(last)], names=["conv", "turn", "key", "place", "h1", "h2", "last"])

    return local.mapInArrow(complete, "conv long, turn long, key binary, place long, h1 long, h2 long, last boolean")


def maximal(placed: DataFrame) -> DataFrame:
    """(conv, n_turns, copies) of the conversations that are no prefix of a longer one, one of each set of equals."""
    whole = placed.where("last").groupBy(F.col("place").alias("n_turns"), "h1", "h2").agg(F.min(F.struct(F.col("conv").isNull(), "conv")).alias("first"), F.count("*").alias("copies"))
    proper = placed.where("not last").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    kept = whole.join(proper, ["n_turns", "h1", "h2"], "left_anti")
    return kept.select(F.col("first.conv").alias("conv"), "n_turns", "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"))


def collapse(chats: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, text) of the maximal conversations; copies: equal conversations, itself included."""
    placed = prefixes(chats)
    kept = maximal(placed).withColumnRenamed("conv", "__k")
    told = [F.xxhash64("conv", F.col("turn").isNull(), "turn", "key").alias("__t1"), F.hash("conv", F.col("turn").isNull(), "turn", "key").alias("__t2")]
    places = placed.join(kept, _same("conv", "__k")).select(*told, "conv", "place", "n_turns", "copies")
    # turns that repeat are combined before the shuffle that the join then uses
    texts = _turns(chats).select(*told, F.struct("role", "text").alias("own")).dropDuplicates(["__t1", "__t2"])
    turns = texts.join(places, ["__t1", "__t2"])
    part = F.floor((F.col("place") - 1) / PART).cast("int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", rendered_turn(F.col("own.role"), F.col("own.text")).alias("t")))), lambda x: x["t"]), "")
    return turns.groupBy(F.col("conv").alias("conv_id"), part.alias("part"), "n_turns", "copies").agg(text.alias("text")).select("conv_id", "part", "n_turns", "copies", "text")


def sql() -> str:
    """collapse over conversations in DuckDB SQL, which compares whole lists of turns."""
    return f"""
with d as (select distinct conv_id, turn, role, text, md5(coalesce('1' || md5(role), '0') || coalesce('1' || md5(text), '0')) as key from conversations),
t as (select *, row_number() over (partition by conv_id order by turn nulls last, role nulls first, key) as place from d),
p as (select conv_id, place, array_agg(key) over (partition by conv_id order by place) as turns from t),
m as (select conv_id, max(place) as n from t group by conv_id),
w as (select m.n as n_turns, p.turns, min(m.conv_id) as conv_id, count(*) as copies from m join p on p.conv_id is not distinct from m.conv_id and p.place = m.n group by m.n, p.turns),
x as (select distinct p.turns from p join m on p.conv_id is not distinct from m.conv_id where p.place < m.n),
k as (select * from w where not exists (select 1 from x where x.turns = w.turns))
select k.conv_id, ((t.place - 1) // {PART})::int as part, k.n_turns, k.copies,
  string_agg('{OPEN}' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '{CLOSE}' || chr(10), '' order by t.place) as text
from k join t on t.conv_id is not distinct from k.conv_id group by 1, 2, 3, 4"""
