"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of all words (its weight's part, at most ``MOST``
times the words it has; what a cap leaves over goes to the others by weight,
until no source is above its cap).  A source is read as a stream of its
documents in a fixed pseudo-random order, as often as its target asks: whole
passes, and one last pass that stops at the document nearest to the target.  A
source's weight over time is a piecewise-linear schedule; its integral is the
cumulative demand, and inverting that at the place of a document in the stream
gives the document's training position between 0 and 1, by which the mix is
sorted.

Running totals are taken in two steps, within hash buckets of a source and
over the buckets, so that a source with most of the rows is spread over all
tasks.  Rows that repeat exactly are counted before they are shuffled.

The mix has docs' columns and ``mix_position`` and ``mix_copy`` (columns of these
names in docs are replaced).

Defined results for odd input: a null or empty text has size 0 and is never
taken; a null source is a source of its own, after all others; a null doc_id
is a doc_id of its own; rows that repeat share their place in the stream, one
behind the other; an empty table gives an empty table; extra columns are left
alone.  A row's order depends on its doc_id and text only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: A source's target is at most so many times its size.
MOST = 3
#: Weight over time of the sources, by (order of the source) mod 3, as (time, weight) knots; only the shape counts.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Sources up to which the ends of their last passes are broadcast, to drop texts that the mix doesn't take.
SOURCES = 100_000
#: Columns of stream_places that the mix needs.
PLACES = ("source", "doc_id", "key", "size", "rows", "nth", "source_size", "target", "passes", "extra", "before")
#: Hex digits of a row's hash that make its bucket within the source.
BUCKET_DIGITS = 3


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """The fixed pseudo-random order of a row, from its doc_id and text."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, nth, target) of every source, from rows (source, size).

    nth is the source's order, from 0.  Its window holds one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", (F.col("nth") % 3 + 1).cast("long"))
    # sources reach their caps in the order of cap / weight, kept in whole numbers; equals reach it together
    d = lambda c: c.cast("decimal(38,0)")
    ratio = W.orderBy("ratio").rangeBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    s = per.withColumn("ratio", F.col("source_size") * (F.lit(6) / F.col("weight")).cast("long")).withColumns(
        {
            "total": F.sum("source_size").over(all_),
            "weights": F.sum("weight").over(all_),
            "s_before": F.coalesce(F.sum("source_size").over(ratio), F.lit(0)),
            "w_before": F.coalesce(F.sum("weight").over(ratio), F.lit(0)),
        }
    )
    capped = d(F.col("source_size") * most) * d(F.col("weights") - F.col("w_before")) <= d(F.col("weight")) * d(F.col("total") - F.col("s_before") * most)
    s = s.withColumn("capped", capped)
    s = s.withColumns(
        {
            "left": F.col("total") - most * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(all_), F.lit(0)),
            "free": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(all_), F.lit(0)),
        }
    )
    target = F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / F.col("free").cast("double"))
    return s.select("source", "source_size", F.col("nth").cast("long").alias("nth"), target.alias("target"))


def _sum_before(df: DataFrame, over: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df and the sum of value over the rows before it: in its bucket, plus all earlier buckets of the group."""
    value_name = f"__{name}"
    df = df.withColumn(value_name, value)
    within = W.partitionBy(*over, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*over, bucket).agg(F.sum(value_name).alias("__t"))
    earlier = W.partitionBy(*over).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__b_{c}") for c in over], F.col(bucket).alias("__b"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__base"))
    on = F.col(bucket) == F.col("__b")
    for c in over:  # never null, so the join takes the window's partitions
        on = on & (F.col(c) == F.col(f"__b_{c}"))
    out = df.withColumn("__in", F.coalesce(F.sum(value_name).over(within), F.lit(0))).join(totals, on)
    return out.withColumn(name, F.col("__in") + F.col("__base")).drop("__in", "__base", "__b", value_name, *[f"__b_{c}" for c in over])


def stream_places(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each distinct (source, doc_id, text), with its copies in the mix.

    Columns source, doc_id, key, size, rows (how often the row occurs), nth,
    source_size, target, passes (whole passes over the source), rest (words of
    the last pass), before (words of the stream before it), stream (words that
    the source gives in all).
    """
    narrow = docs.select("source", "doc_id", row_key("doc_id", "text").alias("key"), word_count("text").alias("size"))
    rows = written(narrow.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("rows")), "mix-rows")
    targets = source_targets(rows.select("source", (F.col("size") * F.col("rows")).alias("size")), most).withColumnRenamed("source", "__s")
    rows = rows.withColumns({"bucket": F.substring("key", 1, BUCKET_DIGITS), "sid": F.xxhash64(F.col("source").isNull(), "source")})
    placed = _sum_before(rows, ["sid"], "bucket", ["key", "doc_id"], F.col("size") * F.col("rows"), "before").drop("bucket", "sid")
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("rest", F.col("target") - (F.col("passes") * F.col("source_size")).cast("double"))
    # rows of the last pass: those whose middle lies before its end; of rows that repeat, the first so many
    extra = F.greatest(F.lit(0), F.least(F.col("rows"), F.ceil((F.col("rest") - F.col("before") - F.col("size") * F.lit(0.5)) / F.col("size")))).cast("long")
    placed = placed.withColumn("extra", F.when(F.col("size") > 0, extra).otherwise(F.lit(0)))
    return placed


def mix_counts(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, position) of every row; position: its first, null if never taken."""
    placed = stream_places(docs, most)
    given = placed.groupBy(F.col("source").alias("__s")).agg(F.sum(F.col("size") * F.col("extra")).alias("__last"))
    each = (
        placed.join(given, F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("i") < F.col("extra"), 1).otherwise(0)).otherwise(0).cast("long"))
    )
    stream = F.col("passes") * F.col("source_size") + F.col("__last")
    place = (F.col("before") + F.col("i") * F.col("size") + F.col("size") * F.lit(0.5)) / stream
    position = F.when(F.col("copies") > 0, training_position(place, F.col("nth") % len(SCHEDULES)))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", position.alias("position"))


def mixed_counts(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The columns of mix_counts, counted on the mix itself: written in full, in training order, and read again.

    taken, copies and position are those of a row's copies in the mix; rows of
    which it has none are added with 0.
    """
    placed = written(stream_places(docs, most).select(*PLACES), "mix-places")
    own = ["source", "doc_id", "text"]
    mixed = written(_mixed(docs.select(own), placed, None).select(*own, F.col("mix_position").alias("position"), "__i"), "mix")
    counted = mixed.select("source", "doc_id", row_key("doc_id", "text").alias("key"), "__i", "position", word_count("text").alias("words"))
    keys = ["source", "doc_id", "key", "__i"]
    counted = counted.groupBy(*keys).agg(F.sum("words").alias("taken"), F.count("*").alias("copies"), F.min("position").alias("position"))
    counted = counted.select(*[F.col(c).alias(f"__c_{c}") for c in keys], "taken", "copies", "position")
    each = placed.select("source", "doc_id", "key", "size", "source_size", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("__i"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return each.join(counted, on, "left").select("doc_id", "size", "source_size", "target", zero("taken"), zero("copies"), "position")


def training_position(place: Column, schedule: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which a source has given this part (0 to 1) of its stream.

    Integrates the schedule's straight pieces and inverts the piece in which
    the cumulative demand reaches ``place``.
    """
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        pieces = [(t0, t1, w0, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        area = sum(p[4] for p in pieces)
        if area <= 0 or any(w < 0 for _, w in knots):
            raise ValueError("a schedule needs weights of which none is negative and some are positive")
        value, done = F.lit(knots[-1][0]), area
        for t0, t1, w0, w1, a in reversed(pieces):
            done -= a
            if a <= 0:
                continue
            need = place * F.lit(area) - F.lit(done)
            slope = (w1 - w0) / (t1 - t0)
            if slope == 0:
                time = F.lit(t0) + need / F.lit(w0)
            else:
                time = F.lit(t0) + (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need)) - F.lit(w0)) / F.lit(slope)
            value = F.when(place * F.lit(area) >= F.lit(done), F.least(time, F.lit(t1))).otherwise(value) if done > 0 else F.when(place * F.lit(area) < F.lit(done + a), F.greatest(time, F.lit(t0))).otherwise(value)
        out = F.when(schedule == k, value).otherwise(out)
    return out


def mix(docs: DataFrame, most: int = MOST, partitions: int | None = None) -> DataFrame:
    """The mix itself: every taken copy as a row with docs' columns, sorted by training position.

    Columns mix_position and mix_copy are added.  Partitions are ranges of positions,
    in order: positions lie nearly evenly between 0 and 1 by the words, so the
    ranges need no sampling pass.
    """
    own = [c for c in docs.columns if c not in ("mix_position", "mix_copy")]
    docs = docs.select(own)
    return _mixed(docs, stream_places(docs, most), partitions).drop("__i")


def _mixed(docs: DataFrame, placed: DataFrame, partitions: int | None) -> DataFrame:
    """mix of docs from their stream_places, with __i: which of the rows that repeat a copy is of."""
    own = docs.columns
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = (F.col("size") > 0) & ((F.col("passes") > 0) | (F.col("extra") > 0))
    given = placed.groupBy(F.col("source").alias("__s")).agg(F.sum(F.col("size") * F.col("extra")).alias("__last"), F.max(F.when(taken, F.col("key"))).alias("__end"))
    placed = placed.join(given, F.col("source").eqNullSafe(F.col("__s"))).where((F.col("size") > 0) & ((F.col("passes") > 0) | (F.col("extra") > 0)))
    placed = placed.select(*[F.col(c).alias(f"__{c}") for c in ("source", "doc_id", "key", "size", "rows", "nth", "source_size", "passes", "extra", "before")], "__last")
    rows = docs.withColumn("__k", row_key("doc_id", "text"))
    if given.count() <= SOURCES:
        # the last pass takes a source's rows up to a key: texts beyond it (or without words) aren't shuffled
        ends = F.broadcast(given.select(F.col("__s").alias("__e"), "__end"))
        rows = rows.join(ends, F.col("source").eqNullSafe(F.col("__e")) & (F.col("__k") <= F.col("__end")), "left_semi")
    on = F.col("source").eqNullSafe(F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__k") == F.col("__key"))
    joined = rows.join(placed.where("__rows = 1"), on)
    several = placed.where("__rows > 1")
    if not several.isEmpty():  # of rows that repeat one is taken, and repeated as often as the mix says
        names = ["__source", "__doc_id", "__key"]
        once = rows.join(several.select(names), on, "left_semi").dropDuplicates(["source", "doc_id", "__k"])
        joined = joined.unionByName(once.join(several, on))
    copies = joined.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1))).withColumn(
        "__n", F.col("__passes") + F.when(F.col("__i") < F.col("__extra"), 1).otherwise(0)
    )
    copies = copies.where(F.col("__n") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    stream = F.col("__passes") * F.col("__source_size") + F.col("__last")
    place = (F.col("mix_copy") * F.col("__source_size") + F.col("__before") + F.col("__i") * F.col("__size") + F.col("__size") * F.lit(0.5)) / stream
    out = copies.withColumn("mix_position", training_position(place, F.col("__nth") % len(SCHEDULES)))
    out = out.select(*own, "mix_position", "mix_copy", "__i")
    part = F.least(F.lit(partitions - 1), F.floor(F.col("mix_position") * partitions)).cast("int")
    return out.repartitionById(partitions, part).sortWithinPartitions("mix_position", "doc_id", "mix_copy")


def sql(most: int = MOST) -> str:
    """mix_counts over documents in DuckDB SQL."""
    from itertools import pairwise

    def position(place: str, knots: tuple) -> str:
        pieces = [(a[0], b[0], a[1], b[1], (b[0] - a[0]) * (a[1] + b[1]) / 2) for a, b in pairwise(knots)]
        area = sum(p[4] for p in pieces)
        value, done = f"{knots[-1][0]!r}::double", area
        for t0, t1, w0, w1, a in reversed(pieces):
            done -= a
            need = f"({place} * {area!r}::double - {done!r}::double)"
            slope = (w1 - w0) / (t1 - t0)
            time = f"({t0!r}::double + {need} / {w0!r}::double)" if slope == 0 else f"({t0!r}::double + (sqrt(greatest(0.0::double, {w0 * w0!r}::double + {2 * slope!r}::double * {need})) - {w0!r}::double) / {slope!r}::double)"
            if done > 0:
                value = f"case when {place} * {area!r}::double >= {done!r}::double then least({time}, {t1!r}::double) else {value} end"
            else:
                value = f"case when {place} * {area!r}::double < {done + a!r}::double then greatest({time}, {t0!r}::double) else {value} end"
        return value

    times = " ".join(f"when {k} then {position('place', s)}" for k, s in enumerate(SCHEDULES))
    return f"""
with d as (select source, doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
  md5(coalesce(doc_id::varchar, '-') || '|' || md5(coalesce(text, ''))) as key from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) - 1 as nth from per),
v as (select *, (nth % 3 + 1)::bigint as weight, source_size * (6 // (nth % 3 + 1)) as ratio from w),
b as (select v.*, (select sum(source_size) from v) as total, (select sum(weight) from v) as weights,
  coalesce((select sum(x.source_size) from v x where x.ratio < v.ratio), 0) as s_before,
  coalesce((select sum(x.weight) from v x where x.ratio < v.ratio), 0) as w_before from v),
c as (select *, source_size * {most} * (weights - w_before) <= weight * (total - s_before * {most}) as capped from b),
t as (select source, source_size, nth, case when capped then (source_size * {most})::double
  else (weight * (total - {most} * coalesce((select sum(source_size) from c where capped), 0)))::double / (select sum(weight) from c where not capped)::double end as target from c),
p as (select d.*, source_size, nth, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes,
  coalesce(sum(size) over (partition by d.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on t.source is not distinct from d.source),
e as (select *, case when size > 0 and before + size * 0.5::double < target - (passes * source_size)::double then 1 else 0 end as extra from p),
g as (select *, case when size > 0 then passes + extra else 0 end::bigint as copies,
  (before + size * 0.5::double) / (passes * source_size + sum(size * extra) over (partition by source))::double as place from e)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies,
  case when copies > 0 then case (nth % 3) {times} end end as position from g"""
