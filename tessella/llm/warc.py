"""WARC records, and revisits that say "not modified" resolved to their originals.

A crawler that asks with a validator and gets 304 writes a revisit record
without a body, of the profile "server not modified" (kind ``revisit``).  Each
is resolved by an as-of join: the latest earlier full
response (its status one of ``FULL``; partial content, redirects, errors and
responses without a status are passed over) with the same canonical URL is its
original, if the validators agree (the entity tag, compared weakly; without
one, the modification date).  The
resolved record has the original's body, and the original's headers updated by
those of the revisit that a 304 may change.

The join is a running "last response so far" over time within a URL, in two
steps: within ranges of time (quantiles of all dates), then over each URL's
ranges.  A URL with a third of all records is so spread over all ranges; only
ids, dates, headers and digests (of WARC files: places in them) take part, and
bodies are joined, or fetched from the files, afterwards.
Records of equal URL and date follow by id, responses before revisits.

Revisits of other profiles (equal payload) say nothing about validators: their
kind is ``other-revisit``, and they come back as they are.  A header that a
record repeats is one, its values joined by ", ".

Status of a record: ``response`` (no revisit), ``other`` (a revisit of another
profile), ``resolved``, ``mismatch`` (the
latest earlier full response has another validator), ``unverified`` (nothing to
compare: the revisit or its original has no validator), ``missing`` (no earlier
full response).  Only ``resolved`` records get the original's body and headers.

Canonical URL: without fragment; host in lower case without user, default port
or a leading ``www.``; scheme ignored; empty path as ``/``; query arguments
sorted.

Defined results for odd input: a null or empty URL is resolved by nothing
(``missing``); a null date comes before all others; records that repeat are
each kept and answered alike; a null header map is an empty one; a null body is
the empty body; extra columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessella.llm.common import file_system, new_folder, passing, written

RANGES = 64
#: Statuses of responses whose body is a whole page, and so may be a revisit's original.
FULL = (200, 203)
#: Headers of a stored response that a 304 never changes: what describes the body, and the connection's own.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
#: Kind of a revisit that isn't "not modified".
OTHER = "other-revisit"
_HEAD = "record_id string, kind string, url string, date timestamp, status int, headers map<string,string>, "
SCHEMA = _HEAD + "body binary"
#: Where a record lies in a folder of WARC files; null if its body is empty.
PLACE = "struct<file:string,offset:bigint,length:bigint>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Effort of gzip.
LEVEL = 3
#: Bytes of a WARC file whose bodies one task fetches, and that it reads at once.
BLOCK, AHEAD = 1 << 22, 1 << 18


# -- canonical URLs --------------------------------------------------------------------------


def canonical_url(url: str | Column) -> Column:
    """host[:port]/path[?arguments, sorted]; null for a null or empty URL."""
    u = F.regexp_replace(F.trim(F.col(url) if isinstance(url, str) else url), "#.*$", "")
    secure = F.lower(u).startswith("https://")
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), "^.*@", ""))
    authority = F.regexp_replace(F.when(secure, F.regexp_replace(authority, ":443$", "")).otherwise(F.regexp_replace(authority, ":80$", "")), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    arguments = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    whole = F.concat(authority, F.when(path == "", "/").otherwise(path), F.when(arguments == "", "").otherwise(F.concat(F.lit("?"), arguments)))
    return F.when(u != "", whole)


# -- resolution -------------------------------------------------------------------------------


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^[wW]/", "")


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal the values are joined."""
    headers = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    joined = lambda k: F.array_join(F.transform(F.filter(pairs, lambda e: e["key"] == k), lambda e: e["value"]), ", ")
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    several = F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), joined(k).alias("value"))))
    return F.when(F.forall(F.map_keys(headers), lambda k: k == F.lower(k)), headers).otherwise(several)


def resolve(records: DataFrame, digest: Column | None = None) -> DataFrame:
    """Every record with what it resolves to, without bodies.

    records: record_id, kind ('response', 'revisit' or another), url, date, status, headers,
    and body unless ``digest`` is given as a column of records, such as the place of
    :func:`read`.  Result: record_id, url, canonical, date, kind, resolution,
    original_id, status, headers, digest.
    """
    body = digest if digest is not None else F.unhex(F.md5(F.coalesce(F.col("body"), F.lit(b""))))  # in binary on the way
    rows = records.select("record_id", "kind", "url", "date", "status", _lower_names(F.col("headers")).alias("headers"), body.alias("digest"))
    rows = rows.withColumn("canonical", canonical_url("url")).withColumn("at", F.coalesce(F.unix_micros("date"), F.lit(-(2**63))))
    rows = written(rows, "warc-records")
    cuts = rows.agg(F.percentile_approx("at", [k / RANGES for k in range(1, RANGES)], 10_000).alias("c")).first()["c"] or []
    span = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>"), lambda c: c <= F.col("at")))
    # what can't be resolved takes no part in the windows, so null URLs gather nowhere
    apart = F.col("canonical").isNull()
    rows = rows.withColumn("span", span)
    full = (F.col("kind") == "response") & F.col("status").isin(*FULL)
    original = F.when(full, F.struct("record_id", "status", "headers", "digest"))
    near = rows.where(~apart).withColumn("own", original)
    order = ["at", F.when(F.col("kind") == "response", 0).otherwise(1), "record_id"]
    within = W.partitionBy("canonical", "span").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    spans = near.groupBy("canonical", "span").agg(F.max_by("own", F.when(full, F.struct("at", "record_id"))).alias("o"))
    earlier = W.partitionBy("canonical").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("canonical", "span", F.last("o", ignorenulls=True).over(earlier).alias("base"))
    found = near.withColumn("inside", F.last("own", ignorenulls=True).over(within)).join(spans, ["canonical", "span"])
    found = found.withColumn("o", F.coalesce("inside", "base")).drop("own", "inside", "base")
    all_ = found.unionByName(rows.where(apart).withColumn("o", F.lit(None).cast(found.schema["o"].dataType)))
    mine, its = F.col("headers"), F.col("o.headers")
    tags = _tag(mine).isNotNull() & _tag(its).isNotNull()
    dates = mine["last-modified"].isNotNull() & its["last-modified"].isNotNull()
    same = F.when(tags, _tag(mine) == _tag(its)).when(dates, mine["last-modified"] == its["last-modified"])
    state = F.when(F.col("kind") == "response", "response").when(F.coalesce(F.col("kind") != "revisit", F.lit(True)), "other").when(F.col("o").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    done = F.col("resolution") == "resolved"
    changed = F.map_filter(mine, lambda k, _: ~k.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(its, lambda k, _: ~F.map_contains_key(changed, k)), changed)
    out = all_.withColumn("resolution", state)
    pick = lambda a, b: F.when(done, a).otherwise(b)
    return out.select(
        "record_id", "url", "canonical", "date", "kind", "resolution",
        pick(F.col("o.record_id"), F.lit(None).cast("string")).alias("original_id"),
        pick(F.col("o.status"), F.col("status")).alias("status"),
        pick(merged, mine).alias("headers"),
        (pick(F.col("o.digest"), F.col("digest")) if digest is not None else F.lower(F.hex(pick(F.col("o.digest"), F.col("digest"))))).alias("digest"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame | str) -> DataFrame:
    """resolved with the body: its own, or the original's; null for an empty one.

    Joined by id and digest (that of resolve's default), so records that repeat stay as many as they are.
    Of records in WARC files, the folder in place of the table: resolved has the column place then, and
    bodies are fetched from there, without a shuffle of any.
    """
    if isinstance(records, str):
        return _fetched(resolved, records)
    told = lambda c: F.xxhash64(c.isNull(), c)
    digest = F.md5(F.coalesce(F.col("body"), F.lit(b"")))
    bodies = records.where(F.length("body") > 0).select(told(F.col("record_id")).alias("__id"), F.xxhash64(digest).alias("__digest"), "body").groupBy("__id", "__digest").agg(F.first("body").alias("body"))
    wanted = told(F.coalesce("original_id", "record_id"))
    # both sides are large, though a plan that begins with a list of files looks small; the keys are those of the groups
    return resolved.join(bodies.hint("merge"), (wanted == F.col("__id")) & (F.xxhash64("digest") == F.col("__digest")), "left").drop("__id", "__digest")


def _fetched(resolved: DataFrame, folder: str) -> DataFrame:
    """resolved with the bodies at their places, read in the order of files and offsets; rows of one place follow each other and share a read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name = file = here = body = None
        data, start = b"", 0
        for batch in batches:
            places = batch.column("place")
            rest = batch.select([c for c in batch.schema.names if c != "place"])
            bodies, size, done = [], 0, 0
            for place in zip(*(c.to_pylist() for c in places.flatten())):
                if place != here:
                    here, body = place, None
                    if place[0] is not None:
                        if place[0] != name:
                            if file:
                                file.close()
                            name, data = place[0], b""
                            file = fs.open_input_file(f"{root}/{name}")
                        _, offset, length = place
                        if not start <= offset <= offset + length <= start + len(data):
                            file.seek(offset)
                            data, start = file.read(max(length, AHEAD)), offset
                        head, _, content = zlib.decompress(memoryview(data)[offset - start :][:length], 31).partition(b"\r\n\r\n")
                        body = _http(_fields(head), content)[1]
                bodies.append(body)
                size += len(body or b"")
                if size > 4_000_000:
                    yield _with(rest.slice(done, len(bodies)), bodies)
                    done, bodies, size = done + len(bodies), [], 0
            if bodies:
                yield _with(rest.slice(done), bodies)
        if file:
            file.close()

    # a place has one task, if AQE doesn't share out a part that has too many rows; rows without one go anywhere
    block = F.when(F.col("place").isNull(), F.xxhash64("record_id")).otherwise(F.xxhash64("place.file", F.floor(F.col("place.offset") / BLOCK)))
    rows = resolved.withColumn("__block", block).hint("rebalance", "__block").drop("__block").sortWithinPartitions("place.file", "place.offset")
    return rows.mapInArrow(run, StructType([*resolved.drop("place").schema.fields, StructField("body", BinaryType())]))


def _with(rows: pa.RecordBatch, bodies: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(bodies, pa.binary())], names=[*rows.schema.names, "body"])


def header_lines(headers: str | Column) -> Column:
    """'name: value' lines, sorted by name."""
    column = F.col(headers) if isinstance(headers, str) else headers
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


# -- files ------------------------------------------------------------------------------------


def _lines(headers: list[tuple[str, object]]) -> bytes:
    return "".join([f"{k}: {v}\r\n" for k, v in headers if v is not None]).encode()


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write records as gzipped WARC files, a gzip member each; (name, records) of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for record_id, kind, url, date, status, headers, body in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                n += 1
                http = b"".join((f"HTTP/1.1 {status or 0} -\r\n".encode(), _lines(headers or []), b"\r\n", body or b""))
                head = [("WARC-Type", "revisit" if kind == OTHER else kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Profile", {"revisit": _PROFILE, OTHER: _SAME_PAYLOAD}.get(kind))]
                head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http))]
                out.write(gzip.compress(b"".join((b"WARC/1.1\r\n", _lines(head), b"\r\n", http, b"\r\n\r\n")), LEVEL, mtime=0))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "records"])

    date = F.date_format(F.to_utc_timestamp("date", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    plain = records.select("record_id", "kind", "url", date.alias("date"), "status", "headers", "body")
    return written(plain.mapInArrow(run, "name string, records long"), "warc-files")


def _members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a stream, one after another."""
    data, at, base, start = memoryview(b""), 0, 0, 0
    unpack, parts = zlib.decompressobj(31), []
    while True:
        if at == len(data):
            base += at
            data, at = memoryview(stream.read(AHEAD)), 0
            if not data:
                if parts and any(parts):
                    raise ValueError("the file ends inside a record")
                return
        piece = data[at : at + (1 << 12)]  # what is left of it is copied for every member
        parts.append(unpack.decompress(piece))
        at += len(piece) - len(unpack.unused_data)
        if unpack.eof:
            yield start, base + at - start, b"".join(parts)
            start = base + at
            unpack, parts = zlib.decompressobj(31), []


@lru_cache(maxsize=4096)
def _name(name: str) -> str:
    return name.strip().lower()


def _fields(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = _name(name), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


def _http(warc: dict[str, str], content: bytes) -> tuple[bytes, bytes]:
    """The HTTP head and the body of a record's content."""
    http, _, body = content[: int(warc.get("content-length", 0))].partition(b"\r\n\r\n")
    return http, body


def parse(member: bytes) -> dict | None:
    """A record of :data:`SCHEMA` from one gzip member; None for other kinds than response and revisit."""
    head, _, content = member.partition(b"\r\n\r\n")
    warc = _fields(head)
    kind = warc.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, body = _http(warc, content)
    if kind == "revisit" and not (warc.get("warc-profile") or _PROFILE).endswith("server-not-modified"):
        kind = OTHER
    status = http.split(b" ", 2)[1:2]
    date = warc.get("warc-date")
    return {
        "record_id": warc.get("warc-record-id"), "kind": kind, "url": warc.get("warc-target-uri"),
        "date": datetime.fromisoformat(date.replace("Z", "+00:00")) if date else None,
        "status": int(status[0]) if status and status[0].isdigit() else None,
        "headers": list(_fields(http).items()), "body": body,
    }


def read(spark: SparkSession, folder: str, names: DataFrame, bodies: bool = True) -> DataFrame:
    """The responses and revisits of gzipped WARC files (name) in folder, a task for each file.

    Without bodies there is the column place (:data:`PLACE`) instead, by which :func:`with_bodies` finds them.
    """
    place = pa.struct([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    last = ("body", pa.binary()) if bodies else ("place", place)
    kind = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("date", pa.timestamp("us", tz="UTC")), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0

                def table() -> pa.RecordBatch:
                    columns = zip(*(r.values() for r in rows))  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, length, member in _members(stream):
                        record = parse(member)
                        if record:
                            size += len(member) if bodies else len(member) - len(record["body"])
                            if not bodies:
                                record["place"] = (name, offset, length) if record.pop("body") else None
                            rows.append(record)
                        if size > 8_000_000:
                            yield table()
                            rows, size = [], 0
                if rows:
                    yield table()

    files = names.select("name")
    return files.repartition(max(1, files.count())).mapInArrow(run, SCHEMA if bodies else f"{_HEAD}place {PLACE}")


# -- the query: captures made from the table of pages --------------------------------------------


def _days(n: Column) -> Column:
    return F.timestamp_micros((F.lit(1_700_000_000) + n.cast("long") * 86_400) * F.lit(1_000_000))


def captures(pages: DataFrame) -> DataFrame:
    """Records like those of a crawl, several of each page.  With day its page_id:

    * on day a full response (r), and a revisit after it (v, day + 200);
    * of pages with remainder 0 or 1 by 4 a second response of other text (s,
      day + 400), then a revisit with the first's tag (w, remainder 0) or the
      second's (x, remainder 1) on day + 600;
    * with remainder 2 a partial response (p, status 206) of other tag, day + 100;
    * with remainder 3 a revisit before the first response (u, day - 1);
    * of every tenth page a revisit of another profile (y, day + 700).

    v's validator is r's tag (weak for every second page), but for pages
    divisible by 5 only the modification date, for those divisible by 7 another
    tag, and for those divisible by 11 none.
    """
    day = F.coalesce("page_id", F.lit(0))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    first, second = F.coalesce("html", F.lit("")), F.concat(F.lit("second text of "), name)
    tag = lambda text: F.concat(F.lit('"'), F.md5(text), F.lit('"'))
    # each once a page: inside the array below they would be computed wherever they stand
    pages = pages.select("url", day.alias("day"), name.alias("name"), first.alias("first"), second.alias("second"), tag(first).alias("tag1"), tag(second).alias("tag2"))
    day, name, first, second, tag1, tag2 = (F.col(c) for c in ("day", "name", "first", "second", "tag1", "tag2"))
    modified = lambda d: F.concat(F.lit("day "), d.cast("string"))
    none = F.create_map().cast("map<string,string>")

    def record(kind: str, mark: str, d: Column, status: int, headers: Column, body: Column) -> Column:
        return F.struct(F.concat(F.lit(mark), name).alias("record_id"), F.lit(kind).alias("kind"), "url", _days(d).alias("date"), F.lit(status).alias("status"), headers.alias("headers"), body.cast("binary").alias("body"))

    def full(mark: str, d: Column, status: int, text: Column, stamp: Column) -> Column:
        return record("response", mark, d, status, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), stamp, F.lit("Last-Modified"), modified(d), F.lit("Cache-Control"), F.lit("max-age=60")), text)

    def again(mark: str, d: Column, validators: Column, kind: str = "revisit") -> Column:
        return record(kind, mark, d, 304, F.map_concat(validators, F.create_map(F.lit("Cache-Control"), F.lit("max-age=90"), F.lit("Content-Length"), F.lit("0"))), F.lit(b""))

    of = lambda n: day % n == 0
    etag = lambda t: F.create_map(F.lit("ETag"), t)
    sent = F.when(of(7), F.lit('"other"')).when(of(2), F.concat(F.lit("W/"), tag1)).otherwise(tag1)
    validators = F.when(of(11), none).when(of(5), F.create_map(F.lit("Last-Modified"), modified(day))).otherwise(etag(sent))
    left = lambda *k: (day % 4).isin(*k)
    records = [
        full("r", day, 200, first, tag1), again("v", day + 200, validators), F.when(left(0, 1), full("s", day + 400, 200, second, tag2)),
        F.when(left(0), again("w", day + 600, etag(tag1))), F.when(left(1), again("x", day + 600, etag(tag2))),
        F.when(left(2), full("p", day + 100, 206, F.lit("part"), F.lit('"part"'))), F.when(left(3), again("u", day - 1, etag(tag1))),
        F.when(of(10), again("y", day + 700, etag(tag2), OTHER)),
    ]
    return pages.select(F.inline(F.filter(F.array(*records), lambda r: r.isNotNull())))


def resolved_pages(pages: DataFrame) -> DataFrame:
    """Captures of pages written as WARC files, read again and resolved; the digest is that of the body joined."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    files = write(captures(pages), folder)
    passing(spark, folder)
    resolved = resolve(read(spark, folder, files, bodies=False), F.col("place"))
    wanted = resolved.select("record_id", "canonical", F.unix_seconds("date").alias("epoch"), "kind", "resolution", "original_id", "status", header_lines("headers").alias("headers"), F.col("digest").alias("place"))
    return with_bodies(wanted, folder).withColumn("digest", F.md5(F.coalesce("body", F.lit(b"")))).drop("body")


def sql() -> str:
    """resolved_pages over pages in DuckDB SQL."""
    clean = "regexp_replace(trim(url, ' '), '#.*$', '')"
    rest = f"regexp_replace({clean}, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    authority = f"lower(regexp_replace(regexp_extract({rest}, '^([^/?]*)', 1), '^.*@', ''))"
    authority = f"regexp_replace(case when starts_with(lower({clean}), 'https://') then regexp_replace({authority}, ':443$', '') else regexp_replace({authority}, ':80$', '') end, '^www\\.', '')"
    path = f"regexp_extract({rest}, '^[^/?]*([^?]*)', 1)"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '')), '&')"
    return f"""
with p as (select coalesce(page_id, 0) as day, coalesce(page_id::varchar, '-') as name, md5(coalesce(html, '')) as one, md5('second text of ' || coalesce(page_id::varchar, '-')) as two,
  case when {clean} <> '' then {authority} || (case when {path} = '' then '/' else {path} end) || (case when {query} = '' then '' else '?' || {query} end) end as canonical from pages),
f as (select 'r' || name as record_id, canonical, day as at_, 200 as status, '"' || one || '"' as etag, one as digest from p
  union all select 's' || name, canonical, day + 400, 200, '"' || two || '"', two from p where day % 4 in (0, 1)
  union all select 'p' || name, canonical, day + 100, 206, '"part"', md5('part') from p where day % 4 = 2),
v as (select 'u' || name as record_id, canonical, day - 1 as at_, '"' || one || '"' as sent, null as modified from p where day % 4 = 3
  union all select 'v' || name, canonical, day + 200, case when day % 11 = 0 or day % 5 = 0 then null when day % 7 = 0 then '"other"' when day % 2 = 0 then 'W/"' || one || '"' else '"' || one || '"' end,
    case when day % 11 <> 0 and day % 5 = 0 then 'day ' || day end from p
  union all select 'w' || name, canonical, day + 600, '"' || one || '"', null from p where day % 4 = 0
  union all select 'x' || name, canonical, day + 600, '"' || two || '"', null from p where day % 4 = 1),
a as (select v.*, regexp_replace(sent, '^W/', '') as etag, o.record_id as o_id, o.etag as o_etag, 'day ' || o.at_ as o_modified, o.digest as o_digest from v left join
  (select v.record_id as v_id, f.*, row_number() over (partition by v.record_id order by f.at_ desc, f.record_id desc) as n from v join f on f.canonical = v.canonical and f.at_ <= v.at_ and f.status = 200) o on o.v_id = v.record_id and o.n = 1),
s as (select *, case when o_id is null then 'missing' when etag is not null then (case when etag = o_etag then 'resolved' else 'mismatch' end)
  when modified is not null then (case when modified = o_modified then 'resolved' else 'mismatch' end) else 'unverified' end as resolution from a)
select record_id, canonical, (1700000000 + at_ * 86400)::bigint as epoch, 'response' as kind, 'response' as resolution, null::varchar as original_id, status::int as status,
  concat_ws(chr(10), 'cache-control: max-age=60', 'content-type: text/html', 'etag: ' || etag, 'last-modified: day ' || at_) as headers, digest from f
union all
select record_id, canonical, (1700000000 + at_ * 86400)::bigint, 'revisit', resolution, case when resolution = 'resolved' then o_id end,
  case when resolution = 'resolved' then 200 else 304 end::int,
  case when resolution = 'resolved' then concat_ws(chr(10), 'cache-control: max-age=90', 'content-type: text/html', 'etag: ' || coalesce(sent, o_etag), 'last-modified: ' || coalesce(modified, o_modified))
  else concat_ws(chr(10), 'cache-control: max-age=90', 'content-length: 0', 'etag: ' || sent, 'last-modified: ' || modified) end,
  case when resolution = 'resolved' then o_digest else md5('') end from s
union all
select 'y' || name, canonical, (1700000000 + (day + 700) * 86400)::bigint, '{OTHER}', 'other', null, 304,
  concat_ws(chr(10), 'cache-control: max-age=90', 'content-length: 0', 'etag: "' || two || '"'), md5('') from p where day % 10 = 0"""
