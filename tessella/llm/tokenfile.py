"""Token ids in binary files: one zstandard frame for each document, one shared dictionary.

A set of files lies in one folder:

* ``dictionary``: the zstandard dictionary, trained on the serialized ids of a
  bounded sample of documents (``SAMPLE_DOCS`` expected, of any length; one of
  more than ``SAMPLE_BYTES`` gives evenly spaced windows; the sample decides
  sizes only, never content); every frame is made with it;
* ``part-*.ids``: a header (magic, id width, SHA-256 of the dictionary), then
  the documents' frames, each compressed separately, in ascending doc_id order;
* ``part-*.idx``: for each document doc_id, whether it is null, the frame's
  offset and length, and its number of ids.  A short document is read with one
  seek and one small frame.

Encoding is the tokenizers library's.  Every worker keeps the ids of the pieces
(parted at blanks and newlines) that it has seen, and asks the library for new
ones only: the file's pre-tokenizer never joins what such a place divides.

Texts aren't shuffled: each is encoded and compressed where it is scanned, and
only frames move, to the file that holds their range of doc_ids.  Bounds of the
ranges are quantiles of doc_id; where one doc_id has many rows, several files
share it by a hash.  A task writes its files under a name of its own attempt, and the
manifest, written last, names the files of the attempts that succeeded.

Defined results for odd input: a null or empty text is the end id alone; a null
doc_id comes after all others; rows that share a doc_id are all written, in the
order of a hash of their ids; a special token's string in a text becomes that
token, as is the library's default; very long texts are one frame like any
other; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.bpe import _Slots
from tessella.llm.common import file_system, new_folder, parts, passing, written

END = 2
#: Pieces, and characters of them, that a worker keeps.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 16_000_000
LEVEL = 3
SAMPLE_DOCS, SAMPLE_BYTES, WINDOWS, DICTIONARY_BYTES = 2000, 16_384, 8, 112_640
#: About how many bytes of ids (before compression) a file holds at most; small tables make a file for each shuffle partition.
FILE_BYTES = 128_000_000
_MAGIC = b"TOKIDS01"
_HEADER = len(_MAGIC) + 4 + 32
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8")])
_LAST = 2**63 - 1
#: How byte-level vocabularies write a blank.
BLANK = "\u0120"
#: Parts pieces; a text that holds it goes to the library whole.
MARK = "\x00"


# -- encoding ------------------------------------------------------------------------------


class Encoder:
    """The tokenizers library behind a cache of pieces.

    A piece is a blank with what follows it up to the next blank or newline, a
    newline, or what follows a newline.  Each is encoded by itself, which is
    right wherever no white space lies next to such a blank or newline; texts
    that have it are parted more carefully.  Pieces are told apart batch by
    batch in Arrow, so Python meets the different ones of a batch only.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._blank = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.lib.get_vocab(with_added_tokens=False).items():
            self._blank[i] = token[0] == BLANK
        self._line = self._whole(["\n"])[0]
        self.entries = entries
        self._known, self._chars = _Slots(), 0
        self._ids, self._ends = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self._joins = np.zeros(1 << 12, bool)  # pieces that must not be parted from their neighbours
        self._hits = np.zeros(1 << 12, np.int32)  # batches that had the piece

    def _forget(self) -> None:
        """Make room: pieces of several batches stay, at most half of the entries; those of one batch go."""
        n = len(self._known)
        often = np.flatnonzero(self._hits[:n] > 1)
        if len(often) > self.entries // 2:
            often = np.sort(often[np.argsort(-self._hits[often], kind="stable")[: self.entries // 2]])
        names = list(self._known)
        known = _Slots()
        known.update(zip(map(names.__getitem__, often.tolist()), range(len(often))))
        counts = self._ends[often + 1] - self._ends[often]
        ids, ends = self._gather(often), np.zeros(len(self._ends), np.int64)
        ends[1 : len(often) + 1] = np.cumsum(counts)
        for name in ("_joins", "_hits"):
            old = getattr(self, name)
            fresh = np.zeros(len(old), old.dtype)
            fresh[: len(often)] = old[often]
            setattr(self, name, fresh)
        self._hits //= 2
        self._known, self._ends, self._chars = known, ends, sum(map(len, known))
        self._ids[: len(ids)] = ids

    def _learn(self) -> None:
        """Ids of the new pieces.

        The library gets many of them as one text: a piece that begins with a
        blank as it is, another after a newline.  A piece has no other blank or
        newline inside, so these tokens tell where each begins.
        """
        new, self._known.new = self._known.new, []
        lines = np.array([c == "\n" for c in new], bool)
        joins = np.array([_odd(c) for c in new], bool)
        blank = np.array([c[:1] == " " for c in new], bool)
        plain = ~joins & ~lines
        counts = np.zeros(len(new), np.int64)
        counts[lines] = len(self._line)
        found = [np.empty(0, np.int32)] * 2
        for side, chosen in enumerate((plain & blank, plain & ~blank)):
            own = [new[k] for k in np.flatnonzero(chosen).tolist()]
            lead = "\n" if side else ""
            got = np.concatenate([np.empty(0, np.int32), *self._whole([lead + lead.join(own[k : k + 200]) for k in range(0, len(own), 200)])])
            start = np.flatnonzero(got == self._line[0]) if side else np.flatnonzero(self._blank[got])
            if len(start) != len(own):
                raise ValueError("the tokenizer doesn't divide text at blanks and newlines")
            counts[chosen] = np.diff(np.append(start, len(got))) - side
            found[side] = np.delete(got, start) if side else got
        at = len(self._known) - len(new)
        used, total = int(self._ends[at]), int(counts.sum())
        if len(self._known) + 1 > len(self._ends):
            for name in ("_ends", "_joins", "_hits"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros(len(self._known), old.dtype))))
        if used + total > len(self._ids):
            self._ids = np.concatenate((self._ids, np.empty(used + total, np.int32)))
        end = used + np.cumsum(counts)
        self._ends[at + 1 : at + 1 + len(new)] = end
        self._joins[at : at + len(new)] = joins
        self._hits[at : at + len(new)] = 0
        for chosen, ids in ((plain & blank, found[0]), (plain & ~blank, found[1]), (lines, np.tile(self._line, int(lines.sum())))):
            own = counts[chosen]
            place = np.cumsum(own) - own
            self._ids[np.repeat((end - counts)[chosen] - place, own) + np.arange(len(ids))] = ids
        self._chars += sum(map(len, new))

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array([t or None for t in texts], pa.string())
        if len(self._known) > self.entries or self._chars > CACHE_CHARS:
            self._forget()
        column = pc.fill_null(column, "").cast(pa.large_string())
        special = pc.match_substring(column, MARK)
        for s in self.special:
            special = pc.or_(special, pc.match_substring(column, s))
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(special, "", column), " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        pieces = pc.split_pattern(marked, MARK)
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.string())
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), MARK)[0].as_py().split(MARK) if len(names) else []
        kinds = np.fromiter(map(self._known.__getitem__, names), np.int64, len(names))
        if self._known.new:
            self._learn()
        self._hits[kinds] += 1
        slots = kinds[coded.indices.to_numpy()]
        sizes = np.asarray(pc.list_value_length(pieces))
        ends = np.cumsum(sizes)
        # a text that begins with a blank or newline has an empty first piece, an empty text has no other
        odd = np.add.reduceat(self._joins[slots], ends - sizes) > 0 if len(slots) else np.zeros(len(sizes), bool)
        counts = self._ends[slots + 1] - self._ends[slots]
        flat = self._gather(slots)
        total = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))]
        out = [flat[a:b] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
        for k in np.flatnonzero(odd | special.to_numpy(zero_copy_only=False)).tolist():
            text = column[k].as_py()
            out[k] = self._parted(text) if text else np.empty(0, np.int32)
        return out

    def _parted(self, text: str) -> np.ndarray:
        """A text with runs of white space or special tokens: parted before such blanks only that divide for sure."""
        if any(s in text for s in self.special) or MARK in text:
            return self._whole([text])[0]
        parts = re.split(r"(?<=\S)(?= \S)", text)
        plain = [p[0] == " " and " " not in p[1:] and "\n" not in p and not _odd(p) for p in parts]
        own = np.array([self._known[p] if ok else -1 for p, ok in zip(parts, plain)], np.int64)
        if self._known.new:
            self._learn()
        odd = [k for k, ok in enumerate(plain) if not ok]
        rest = dict(zip(odd, self._whole([parts[k] for k in odd])))
        return np.concatenate([rest[k] if k in rest else self._ids[self._ends[o] : self._ends[o + 1]] for k, o in enumerate(own)])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        start, count = self._ends[slots], self._ends[slots + 1] - self._ends[slots]
        place = np.cumsum(count) - count
        return self._ids[np.repeat(start - place, count) + np.arange(int(count.sum()))]


def _odd(piece: str) -> bool:
    """Whether white space lies at an end of the piece, other than its one leading blank."""
    if piece == "\n":
        return False
    own = piece[1:] if piece[:1] == " " else piece
    return not own or own[0].isspace() or own[-1].isspace()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def deserialized(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


# -- the dictionary ----------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized ids, never empty.

    Where the samples are too few or too uniform for zstandard's trainer, their
    own bytes are the dictionary (one of raw content, which zstandard knows by
    the missing magic number).
    """
    import zstandard as zstd

    samples = sorted(s for s in samples if s)
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 20_000:
        try:
            return zstd.train_dictionary(min(size, max(1024, total // 10)), samples, level=LEVEL).as_bytes()
        except zstd.ZstdError:
            pass  # too uniform; below
    return (np.full(4, END, "<u2").tobytes() + b"".join(samples))[-size:]


def _pieces(raw: bytes) -> bytes:
    """What a document gives to the sample: all its bytes, or of a long one evenly spaced windows of them."""
    if len(raw) <= SAMPLE_BYTES:
        return raw
    width = SAMPLE_BYTES // WINDOWS // 4 * 4
    starts = np.linspace(0, len(raw) - width, WINDOWS).astype(np.int64) // 4 * 4
    return b"".join(raw[s : s + width] for s in starts.tolist())


def dictionary_of(docs: DataFrame, path: str) -> tuple[bytes, float]:
    """The dictionary for docs (doc_id, text), and about how many bytes all ids take.

    From a sample by hash of an expected SAMPLE_DOCS documents, of any length.
    """
    count = docs.count()
    key = F.xxhash64(F.lit("dictionary"), "doc_id", F.octet_length("text"))  # no text is hashed
    share = F.pmod(key, F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(1, count)) * (1 << 30)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for own in parts(batch, 1):
                raw = [serialized(np.append(x, END), enc.width) for x in enc.encode_batch(own.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([_pieces(r) for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64())], names=["raw", "size"])

    sampled = docs.select("doc_id", "text").where(share).orderBy(key).limit(2 * SAMPLE_DOCS)
    rows = sampled.mapInArrow(run, "raw binary, size long").collect()
    return train_dictionary([bytes(r["raw"]) for r in rows]), count * sum(r["size"] for r in rows) / max(1, len(rows))


@lru_cache(maxsize=4)
def _codecs(dictionary: bytes):
    import zstandard as zstd

    shared = zstd.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=shared), zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary))


# -- writing -------------------------------------------------------------------------------


def _bounds(docs: DataFrame, files: int) -> np.ndarray:
    """files - 1 ascending bounds of doc_id; a bound occurs several times where one doc_id fills several files."""
    if files < 2:
        return np.empty(0, np.int64)
    at = [k / files for k in range(1, files)]
    got = docs.select(F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("d")).agg(F.percentile_approx("d", at, 100 * files).alias("b")).first()["b"]
    return np.array(got or [], np.int64)


def write(docs: DataFrame, path: str, folder: str, files: int | None = None, end: int = END) -> DataFrame:
    """Write the ids of docs (doc_id, text) in folder; the manifest, one row a file in doc_id order.

    Manifest: part, name, documents, tokens, start (ids in earlier files).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary, size = dictionary_of(docs, path)
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -int(-size // FILE_BYTES))
    digest = hashlib.sha256(dictionary).digest()
    bounds = _bounds(docs, files)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = encoder(path), _codecs(dictionary)[0]
        for batch in batches:
            for own in parts(batch, 1, 4_000_000):
                key = own.column(0).fill_null(_LAST).to_numpy()
                low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                raw = [serialized(np.append(x, end), enc.width) for x in enc.encode_batch(own.column(1))]
                tie = np.array([int.from_bytes(hashlib.blake2b(r, digest_size=7).digest(), "big") for r in raw], np.int64)
                part = low + ((high - low + 1) * (tie / 2.0**56)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(part, high).astype(np.int32)),
                        own.column(0),
                        pa.array(tie),
                        pa.array([len(r) // enc.width for r in raw], pa.int64()),
                        pa.array([pack.compress(r) for r in raw], pa.binary()),
                    ],
                    names=["part", "doc_id", "tie", "n_tokens", "frame"],
                )

    frames = docs.mapInArrow(compress, "part int, doc_id long, tie long, n_tokens long, frame binary")
    placed = frames.repartitionById(files, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "tie")
    width = encoder(path).width

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index, at, part, name = None, [], 0, None, ""
        fs, root = file_system(folder)

        def close() -> pa.RecordBatch:
            out.close()
            rows = np.concatenate(index)
            with fs.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(rows.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([int(rows["n_tokens"].sum())], pa.int64())], names=["part", "name", "documents", "tokens"])

        for batch in batches:
            for k in np.unique(batch.column("part").to_numpy()).tolist():
                own = batch.filter(pa.array(batch.column("part").to_numpy() == k))
                if k != part:
                    if out is not None:
                        yield close()
                    part, name, index, at = k, f"part-{k:06d}-{uuid.uuid4().hex}", [], _HEADER
                    out = fs.open_output_stream(f"{root}/{name}.ids")
                    out.write(_MAGIC + np.uint32(width).tobytes() + digest)
                data = own.column("frame").to_pylist()
                rows = np.zeros(len(data), _INDEX)
                rows["doc_id"] = own.column("doc_id").fill_null(0).to_numpy()
                rows["null"] = own.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                rows["length"] = [len(d) for d in data]
                rows["offset"] = at + np.cumsum(rows["length"]) - rows["length"]
                rows["n_tokens"] = own.column("n_tokens").to_numpy()
                out.write(b"".join(data))
                index.append(rows)
                at += int(rows["length"].sum())
        if out is not None:
            yield close()

    manifest = written(placed.mapInArrow(save, "part int, name string, documents long, tokens long"), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


# -- reading -------------------------------------------------------------------------------


class Reader:
    """Random access to one file of ids."""

    def __init__(self, folder: str, name: str) -> None:
        fs, root = file_system(folder)
        with fs.open_input_stream(f"{root}/dictionary") as f:
            dictionary = f.read()
        with fs.open_input_stream(f"{root}/{name}.idx") as f:
            self.index = np.frombuffer(f.read(), _INDEX)
        self.file = fs.open_input_file(f"{root}/{name}.ids")
        head = self.file.read(_HEADER)
        if head[: len(_MAGIC)] != _MAGIC or head[-32:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} is no file of ids made with this folder's dictionary")
        self.width = int(np.frombuffer(head[len(_MAGIC) : -32], "<u4")[0])
        self._unpack = _codecs(bytes(dictionary))[1]

    def ids(self, at: int) -> np.ndarray:
        """The ids of the document at this place in the index."""
        row = self.index[at]
        self.file.seek(int(row["offset"]))
        return deserialized(self._unpack.decompress(self.file.read(int(row["length"]))), self.width)

    def of(self, doc_id: int) -> np.ndarray:
        """The ids of the first document with this doc_id."""
        known = self.index["doc_id"][self.index["null"] == 0]
        at = int(np.searchsorted(known, doc_id))
        if at == len(known) or known[at] != doc_id:
            raise KeyError(doc_id)
        return self.ids(at)

    def all(self, size: int = 4_000_000) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(place of the first, ids of consecutive documents), about so many bytes at a time."""
        first = 0
        while first < len(self.index):
            ends = self.index["offset"][first:] + self.index["length"][first:]
            start = int(self.index["offset"][first])
            last = first + max(1, int(np.searchsorted(ends, start + size, "right")))
            self.file.seek(start)
            raw = memoryview(self.file.read(int(ends[last - first - 1]) - start))
            out = []
            for row in self.index[first:last]:
                at = int(row["offset"]) - start
                out.append(deserialized(self._unpack.decompress(raw[at : at + int(row["length"])]), self.width))
            yield first, out
            first = last

    def close(self) -> None:
        self.file.close()


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                reader = Reader(folder, name)
                for first, docs in reader.all():
                    index = reader.index[first : first + len(docs)]
                    counts = np.array([len(x) for x in docs], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(index["doc_id"].astype(np.int64), mask=index["null"] != 0),
                            pa.array(start + np.cumsum(counts) - counts),
                            pa.array(counts),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(counts.sum())
                reader.close()

    files = manifest.select("name", "start")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write docs in the shared folder and read the files back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    manifest = write(docs, path, folder)
    passing(spark, folder)
    return read_digests(spark, folder, manifest)
