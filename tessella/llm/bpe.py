"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  A round looks every adjacent
pair up in the sorted array of pair keys (binary search), takes for each word
its lowest-ranked pair and merges all that pair's occurrences in the word, left
to right; words without a known pair leave the array.  This equals the usual
one-merge-at-a-time procedure when every merge makes a new token out of tokens
made before it, which is checked when a vocabulary is loaded.

Defined results for odd input: a null or empty text has no tokens and decodes
to the empty string; a special token's string inside a text becomes that
token, as in the tokenizers library's default; very long words take more
rounds, never a truncated result; repeated rows are encoded alike; extra
columns are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessella.llm.common import frugal, parts, with_fields

_NONE = np.iinfo(np.int64).max
#: A worker's cache of chunks is emptied beyond so many entries or characters.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 8_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], spare = chr(spare), spare + 1
    return out


class MergeTable:
    """A BPE vocabulary as arrays: sorted pair keys, their ranks and products."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.size = max(vocab.values(), default=0) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        birth = np.full(self.size, -1, np.int64)
        birth[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(birth[left], birth[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge's parts must be made before it, and each token by one merge")
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        sym = self.inner[raw]
        full = lengths > 0
        sym[ends[full] - 1] = self.last[raw[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        rank, slot = self._ranks(sym, word, np.arange(len(sym)))
        while len(sym) > 1:
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            open_ = best != _NONE
            if not open_.all():
                done_sym.append(sym[~open_])
                done_word.append(word[~open_])
                sym, word, rank, slot, best = sym[open_], word[open_], rank[open_], slot[open_], best[open_]
                if not len(sym):
                    break
            hit = self._apart(np.flatnonzero(rank == best))
            sym[hit] = self.made[slot[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, rank, slot = sym[keep], word[keep], rank[keep], slot[keep]
            hit -= np.arange(len(hit))  # where the new symbols are now
            near = np.union1d(hit, hit[hit > 0] - 1)
            rank[near], slot[near] = self._ranks(sym, word, near)
        done_sym.append(sym)
        done_word.append(word)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_sym)[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _ranks(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, and place among the sorted keys, of the pairs that start at these positions."""
        rank, slot = np.full(len(at), _NONE, np.int64), np.zeros(len(at), np.int64)
        pair = np.flatnonzero(at + 1 < len(sym))
        pair = pair[word[at[pair]] == word[at[pair] + 1]]
        key = sym[at[pair]] * self.size + sym[at[pair] + 1]
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        ok = self.keys[found] == key
        rank[pair[ok]], slot[pair[ok]] = self.ranks[found[ok]], found[ok]
        return rank, slot

    @staticmethod
    def _apart(hit: np.ndarray) -> np.ndarray:
        """Of runs of adjacent positions (a a a) every second one, from the left."""
        if len(hit) < 2 or (np.diff(hit) > 1).all():
            return hit
        start = np.concatenate(([True], np.diff(hit) > 1))
        begin = hit[start][np.cumsum(start) - 1]
        return hit[(hit - begin) % 2 == 0]


class _Slots(dict):
    """Chunk -> slot; asking for an unknown chunk gives it the next slot and notes it."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = at = len(self)
        return at


def _understood(spec: dict) -> None:
    """Raise ValueError for a file of which anything would be encoded or decoded otherwise than here."""
    model = spec["model"]
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    odd = [k for k, v in plain.items() if (model.get(k) or None) != (v or None)]
    for token in spec.get("added_tokens") or []:
        odd += [f"added token {token['content']}: {k}" for k in ("single_word", "lstrip", "rstrip", "normalized") if token.get(k)]
        if not token["content"].startswith("<|"):
            odd.append(f"added token {token['content']}")
    if spec.get("post_processor"):
        odd.append("post_processor")
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": not model.get("end_of_word_suffix")}
    splits = spec.get("pre_tokenizer") or {}
    if model.get("end_of_word_suffix"):
        normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        if spec.get("normalizer") != {"type": "Sequence", "normalizers": normal}:
            odd.append("normalizer")
        if spec.get("decoder"):
            odd.append("decoder")
        own = splits.get("pretokenizers") or [{}]
        if len(own) != 2 or {k: own[0].get(k) for k in ("type", "behavior", "invert")} != {"type": "Split", "behavior": "Removed", "invert": True}:
            odd.append("pre_tokenizer")
        splits = own[-1]
    else:
        if spec.get("normalizer"):
            odd.append("normalizer")
        if (spec.get("decoder") or {}).get("type") not in (None, "ByteLevel"):
            odd.append("decoder")
    if {k: splits.get(k) for k in level} != level:
        odd.append("pre_tokenizer")
    if odd:
        raise ValueError("a tokenizer file of another kind: " + ", ".join(odd))


class Tokenizer:
    """A tokenizers-library BPE file, encoded by :class:`MergeTable`.

    Two kinds of file are understood: byte-level BPE with word ends, whose text
    is put in NFC and lower case and split by a regular expression with white
    space dropped; and plain byte-level BPE, where a blank belongs to the word
    that follows it.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        _understood(spec)
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.table = MergeTable(vocab, merges, suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = s
        self.numerals = [str(i) for i in range(size)]
        self.words_end = bool(suffix)
        if self.words_end:
            split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            self._split = regex.compile(split["pattern"]["Regex"])
            self._ascii = re.compile(self._split.pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r"))
        else:
            self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            self._ascii = self._split
        self._reset()

    def _reset(self) -> None:
        self._known = _Slots()
        self._chars = 0
        self._ids = np.empty(1 << 16, np.int32)
        self._ends = np.zeros(1 << 12, np.int64)

    # -- chunks: runs without white space, encoded once for each worker ----------

    def _normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each letter by itself: no final sigma
        return text.lower()

    def _chunks(self, text: str) -> list[str]:
        text = self._normal(text)
        if re.search("[\x1c-\x1f]", text):  # blank to str.split, not to the pattern
            return regex.split(r"\s+", text.strip(" "))
        return text.split()

    def _learn(self) -> None:
        """Encode the chunks that were asked for and have no ids yet."""
        new, self._known.new = self._known.new, []
        pieces = [(self._ascii if c.isascii() else self._split).findall(c) for c in new]
        ids, counts = self.table.encode([p.encode("utf-8", "surrogatepass") for x in pieces for p in x])
        ends = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([len(x) for x in pieces])]
        at = len(self._known) - len(new)
        used = int(self._ends[at])
        if len(self._known) + 1 > len(self._ends):
            self._ends = np.concatenate((self._ends, np.zeros(len(self._known), np.int64)))
        if used + len(ids) > len(self._ids):
            self._ids = np.concatenate((self._ids, np.empty(used + len(ids), np.int32)))
        self._ids[used : used + len(ids)] = ids
        self._ends[at + 1 : at + 1 + len(new)] = used + ends
        self._chars += sum(map(len, new))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The token ids of each text, as int32 arrays."""
        if len(self._known) > CACHE_ENTRIES or self._chars > CACHE_CHARS:
            self._reset()
        slot = self._known.__getitem__
        parts: list[list[np.ndarray | int]] = []
        for text in texts:
            own: list[np.ndarray | int] = []
            pieces = self._special.split(text) if text and self._special and "<|" in text else [text or ""]
            for k, piece in enumerate(pieces):
                if k % 2:
                    own.append(self.special[piece])
                elif piece:
                    chunks = self._chunks(piece)
                    own.append(np.fromiter(map(slot, chunks), np.int64, len(chunks)))
            parts.append(own)
        if self._known.new:
            self._learn()
        out = []
        for own in parts:
            arrays = [np.array([x], np.int32) if isinstance(x, int) else self._gather(x) for x in own]
            out.append(arrays[0] if len(arrays) == 1 else np.concatenate([np.empty(0, np.int32), *arrays]))
        return out

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        start, count = self._ends[slots], self._ends[slots + 1] - self._ends[slots]
        place = np.cumsum(count) - count
        return self._ids[np.repeat(start - place, count) + np.arange(int(count.sum()))]

    def decode(self, ids: np.ndarray) -> str:
        """What the tokenizers library's decode() gives for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def numeral_text(self, ids: np.ndarray) -> str:
        return " ".join(map(self.numerals.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each worker process and file."""
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and an array<int> column of token ids.

    No shuffle: one Arrow pass over the scan.  An existing column of the name
    ``ids`` is replaced.
    """
    keep = docs.select(*[c for c in docs.columns if c != ids])
    at = keep.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in parts(batch, at):
                arrays = tok.encode_batch(part.column(at).to_pylist())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *arrays])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids])

    return keep.mapInArrow(run, with_fields(keep, **{ids: ArrayType(IntegerType())}))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of encoded and the decoded text of the ids; null ids decode to ''."""
    keep = encoded.select(*[c for c in encoded.columns if c != text])
    at = keep.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            column = batch.column(at)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            texts = [tok.decode(flat[a:b]) if ok else "" for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return keep.mapInArrow(run, with_fields(keep, **{text: StringType()}))


def digests(docs: DataFrame, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, and the extra columns as they are.

    Encodes and decodes in the same pass, so ids and decoded texts never cross
    between the JVM and Python.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in parts(batch, 1):
                arrays = tok.encode_batch(part.column(1).to_pylist())
                one = [hashlib.sha256(tok.numeral_text(x).encode()).hexdigest() for x in arrays]
                two = [hashlib.sha256(tok.decode(x).encode()).hexdigest() for x in arrays]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in arrays], pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), *part.columns[2:]],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra],
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    own = StructType([StructField("doc_id", LongType()), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return columns.mapInArrow(run, StructType([*own.fields, *(columns.schema[c] for c in extra)]))
