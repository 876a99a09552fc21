"""Line dedup by site-relative frequency.

The frequency of a line on a host is the number of its pages that contain it,
divided by the number of all pages of the host.  A page is no evidence against
its own lines, so it is left out of the count: a line is boilerplate on a page
where the host's other pages that contain it, over all pages of the host,
exceed ``ratio``.  That one formula holds for hosts of any size; a host of one
page loses nothing.  Lines are compared without the blanks at their ends; blank
lines are never boilerplate.  All lines of all pages count.

Only 64-bit line hashes are shuffled for the counts, and they are combined
before the shuffle, so neither a large host nor a line on every page gathers in
one task.  A host has fewer than (lines of a page) / ratio boilerplate lines.
They come together as one set for each host, and up to ``SET_ROWS`` hashes (8
MB, counted first) all sets are broadcast to the pages, so no text is shuffled.
Beyond that each line hash of a page meets its host's by a shuffle join, and the
lines to drop come back to the texts in another.

Defined results for odd input: a null text stays null and counts as a page
without lines; an empty text stays empty; a null host is a host of its own; a
page left without lines has the empty text and stays; a row that occurs twice
counts twice; rows that share a doc_id are judged each by its own host and
text; of extra columns ``lines_dropped`` is replaced and the others come back as
they were (names that begin with __ are reserved).  An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

RATIO = 0.02
#: Line hashes, of all hosts together, up to which they are broadcast.
SET_ROWS = 1_000_000


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def frequent_lines(pages: DataFrame, host: str, text: str, ratio: float = RATIO) -> DataFrame:
    """(host, line, pages, host_pages): hashes of the lines above the ratio, once for each host."""
    distinct = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _hash))
    found = pages.select(F.col(host).alias("host"), F.explode(distinct).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where("pages > 1").alias("f")
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages"))
    above = F.col("pages") - 1 > F.col("host_pages") * F.lit(ratio)
    return found.join(totals.alias("t"), F.col("f.host").eqNullSafe(F.col("t.host"))).where(above).select("f.host", "line", "pages", "host_pages")


def drop_boilerplate(pages: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """pages with the boilerplate lines gone from ``text``, and lines_dropped."""
    pages = pages.drop("lines_dropped")
    bad = written(frequent_lines(pages, host, text, ratio).select(F.col("host").alias("__h"), "line"), "frequent-lines")
    if bad.count() <= SET_ROWS:
        sets = F.broadcast(bad.groupBy("__h").agg(F.collect_set("line").alias("__drop")))
        joined = pages.join(sets, F.col(host).eqNullSafe(F.col("__h")), "left").drop("__h")
    else:
        joined = _with_own_drops(pages, bad, key, host, text)
    lines = _lines(text)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__drop"), _hash(x)))
    touched = F.col("__drop").isNotNull() & F.col(text).isNotNull()
    # the lines that stay are made once, then counted
    joined = joined.withColumn("__kept", F.when(touched, kept))
    return joined.withColumns(
        {
            text: F.when(touched, F.array_join("__kept", "\n")).otherwise(F.col(text)),
            "lines_dropped": F.when(touched, (F.size(lines) - F.size("__kept")).cast("long")).otherwise(F.lit(0).cast("long")),
        }
    ).drop("__drop", "__kept")


def _with_own_drops(pages: DataFrame, bad: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """pages with the set of their own boilerplate lines, by shuffles.

    Rows are told by key, host and text (its hash), so rows without a key don't gather.
    """
    page = F.xxhash64(F.col(key), F.col(host), F.col(text))
    seen = pages.select(page.alias("__k"), F.col(host).alias("__p"), F.explode(F.array_distinct(F.transform(_lines(text), _hash))).alias("__line"))
    drops = seen.join(bad, F.col("__p").eqNullSafe(F.col("__h")) & (F.col("__line") == F.col("line"))).groupBy("__k").agg(F.collect_set("__line").alias("__drop"))
    return pages.withColumn("__page", page).join(drops, F.col("__page") == F.col("__k"), "left").drop("__page", "__k")


def sql(ratio: float = RATIO) -> str:
    """The query over documents in DuckDB SQL."""
    return f"""
with d as (select row_number() over () as r, doc_id, source, text from documents),
l as (select r, source, i, line, trim(line, ' ') as t from (
  select r, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d)),
n as (select source, count(*) as host_pages from d group by source),
bad as (select f.source, f.t from (select source, t, count(distinct r) as pages from l where t <> '' group by source, t) f
  join n on n.source is not distinct from f.source where f.pages - 1 > n.host_pages * {ratio!r}::double),
k as (select l.r, string_agg(case when bad.t is null then l.line end, chr(10) order by l.i) as text, count(bad.t) as lines_dropped
  from l left join bad on bad.source is not distinct from l.source and bad.t = l.t group by l.r)
select d.doc_id, d.source, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(k.lines_dropped, 0) as lines_dropped
from d left join k using (r)"""
