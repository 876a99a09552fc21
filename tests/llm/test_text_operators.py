"""Operators on documents against brute force."""

from __future__ import annotations

import ctypes
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, lines, mixing, quality, queries, setsketch, tokenfile
from tessella.llm.common import new_folder, parts
from tessella.llm.queries import tokenizer_file
from tests.llm.conftest import documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [" ", "  ", "\n", "\t", " ", "\x1c", "　", "\x85", "'s", "don't", "12", "3.14", "é", "é", "ß", "İ", "Σ", "ΑΣ", "中", "文字", "🙂", "<|endoftext|>", "<|startoftext|>", "<|", "...", "a", "Word", "\r\n", "\x00", "ǆ", "ﬁ", "½"]


def collected(df):
    return [tuple(r) for r in df.collect()]


# -- encoding ------------------------------------------------------------------------------


@pytest.mark.parametrize("name, make", [("word_bpe_49k.json", bpe.Tokenizer), ("byte_bpe_50k.json", tokenfile.Encoder)])
def test_encoders_equal_the_library(name, make):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [None, "", " ", "a  b", "a \n b", " a", "a ", "a<|endoftext|> b", "x" * 5000, "ab " * 3000]
    texts += [join.join(rng.choice(ODD) for _ in range(rng.randint(1, 25))) for join in ("", " ") for _ in range(1500)]
    mine, lib = make(tokenizer_file(name)), Tokenizer.from_file(tokenizer_file(name))
    for text, ids, want in zip(texts, mine.encode_batch(texts), lib.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids.tolist() == want.ids, repr(text)
        if isinstance(mine, bpe.Tokenizer):
            assert mine.decode(ids) == lib.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("change", [{"normalizer": None}, {"decoder": {"type": "BPEDecoder"}}, {"post_processor": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "Whitespace"}}, "ignore_merges", "lstrip"])
def test_other_tokenizer_files_are_refused(tmp_path, change):
    import json

    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    if change == "ignore_merges":
        spec["model"]["ignore_merges"] = True
    elif change == "lstrip":
        spec["added_tokens"][0]["lstrip"] = True
    else:
        spec |= change
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="another kind"):
        bpe.Tokenizer(str(tmp_path / "t.json"))


def test_merges_among_equal_symbols():
    vocab = {c: i for i, c in enumerate(bpe.byte_alphabet())} | {"aa": 256, "aaa": 257, "ab": 258}
    table = bpe.MergeTable(vocab, [("a", "a"), ("aa", "a"), ("a", "b")])
    ids, counts = table.encode([b"aaaaa", b"", b"aab", b"ab"])
    names = {v: k for k, v in vocab.items()}
    assert counts.tolist() == [2, 0, 2, 1] and [names[i] for i in ids] == ["aa", "aaa", "aa", "b", "ab"]
    with pytest.raises(ValueError):
        bpe.MergeTable(vocab, [("aa", "a"), ("a", "a")])


def test_bpe_digests(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)

    def want(doc_id, text):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))

    rows = awkward.select("doc_id", "text").collect()
    assert sorted(collected(bpe.digests(awkward, path)), key=repr) == sorted((want(*r) for r in rows), key=repr)
    assert bpe.digests(nothing, path).count() == 0
    back = bpe.decode(bpe.encode(awkward, path), path)
    assert back.columns == [c for c in awkward.columns if c != "ids"] + ["ids", "decoded"] and back.count() == awkward.count()


def test_token_files(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    folder = new_folder(spark, "test-ids")
    manifest = tokenfile.write(awkward, path, folder, files=5)
    got = sorted(collected(tokenfile.read_digests(spark, folder, manifest)), key=lambda r: r[1])
    ids = {}
    for doc_id, text in awkward.select("doc_id", "text").collect():
        own = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        ids.setdefault(doc_id, []).append((len(own), zlib.crc32(own.tobytes())))
    assert [r[0] for r in got] == [*sorted(i for i in (r[0] for r in got) if i is not None), None, None]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    seen = defaultdict(list)
    for r in got:
        seen[r[0]].append(r[2:])
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in ids.items()}
    name = manifest.orderBy("part").first()["name"]
    reader = tokenfile.Reader(folder, name)
    assert zlib.crc32(reader.of(2).astype("<u4").tobytes()) == ids[2][0][1] and reader.of(2).tolist() == [2]
    with pytest.raises(KeyError):
        reader.of(-1)
    reader.close()
    assert tokenfile.round_trip(nothing, path).count() == 0


def test_shared_dictionary():
    rng = np.random.default_rng(1)
    samples = [np.concatenate([rng.integers(0, 300, 5) for _ in range(40)]).astype("<u2").tobytes() for _ in range(400)]
    for own in (samples, samples[:3], [b"\x02\x00"], [], [samples[0]] * 500):  # few, none and uniform ones too
        dictionary = tokenfile.train_dictionary(own)
        pack, unpack = tokenfile._codecs(dictionary)
        assert dictionary and all(unpack.decompress(pack.compress(s)) == s for s in samples)
    import zstandard as zstd

    plain, pack = zstd.ZstdCompressor(level=tokenfile.LEVEL), tokenfile._codecs(tokenfile.train_dictionary(samples))[0]
    assert sum(len(pack.compress(s)) for s in samples) < sum(len(plain.compress(s)) for s in samples)
    long = bytes(range(256)) * 4000
    assert len(tokenfile._pieces(long)) == tokenfile.SAMPLE_BYTES and tokenfile._pieces(long)[-4:] == long[-4:]


def test_dictionary_end_to_end(spark, awkward):
    """The files' frames are made with a trained dictionary, which the long text takes part in."""
    import zstandard as zstd

    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(12)
    docs = documents(spark, [(n, prose(rng, 200), "s") for n in range(200)]).unionByName(awkward)
    folder = new_folder(spark, "test-ids")
    manifest = tokenfile.write(docs, path, folder, files=2)
    fs, root = tokenfile.file_system(folder)
    with fs.open_input_stream(f"{root}/dictionary") as f:
        dictionary = bytes(f.read())
    assert len(dictionary) > 1024 and zstd.ZstdCompressionDict(dictionary).dict_id()
    assert tokenfile.read_digests(spark, folder, manifest).count() == docs.count()
    reader = tokenfile.Reader(folder, manifest.orderBy("part").first()["name"])
    row = reader.index[0]
    reader.file.seek(int(row["offset"]))
    assert zstd.get_frame_parameters(reader.file.read(int(row["length"]))).dict_id == zstd.ZstdCompressionDict(dictionary).dict_id()
    reader.close()


def test_encoder_forgets_rare_pieces():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    mine, lib = tokenfile.Encoder(path, entries=50), Tokenizer.from_file(path)
    rng = random.Random(13)
    for _ in range(40):
        texts = [prose(rng, 30) + "\nnew line. end" for _ in range(3)]
        assert [x.tolist() for x in mine.encode_batch(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_count_follows_the_data(spark, awkward, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 20_000)
    manifest = tokenfile.write(awkward, tokenizer_file("byte_bpe_50k.json"), new_folder(spark, "test-ids"))
    assert manifest.agg(F.max("part")).first()[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- quality ------------------------------------------------------------------------------


def junk(rng, n):
    return " ".join(rng.choice(WORDS).upper() + "!!" for WORDS in [["ab", "cd", "ef"]] for _ in range(n))


def test_quality(spark, awkward, nothing):
    rng = random.Random(2)
    rows = [(n, junk(rng, rng.randint(5, 200)) if n % 4 == 0 else prose(rng, rng.randint(5, 200)), "s") for n in range(600)]
    labels = spark.createDataFrame([(n, int(n % 4 != 0), 0) for n in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = collected(quality.scores(documents(spark, rows), labels))
    assert len(got) == 600
    for doc_id, held, score, predicted in got:
        assert held == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == int(score >= 0.3)
    assert np.mean([p == (d % 4 != 0) for d, h, _, p in got if h]) > 0.98
    good = quality.keep_good(documents(spark, rows), labels)
    assert {r[0] for r in good.collect()} == {d for d, _, _, p in got if p}
    odd = collected(quality.scores(awkward, labels))
    assert len(odd) == awkward.count() and all(not h for d, h, _, _ in odd if d is None)
    assert quality.scores(nothing, labels).count() == 0
    none = labels.limit(0)
    assert {r[2] for r in collected(quality.scores(awkward, none))} == {0.5}
    one = labels.where("quality = 1")
    assert {r[2] for r in collected(quality.scores(awkward, one))} == {1.0}


def test_quality_filter_trains_in_one_python_pass(spark, monkeypatch):
    """Two Python passes in a stage are two workers a core, and workers stay for the later stages."""
    rng = random.Random(5)
    docs = documents(spark, [(n, junk(rng, 30) if n % 4 == 0 else prose(rng, 30), "s") for n in range(200)])
    labels = spark.createDataFrame([(n, int(n % 4 != 0)) for n in range(200)] + [(3, 0)], "doc_id long, quality int")
    plans, plain = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    good = quality.keep_good(docs, labels)
    assert [p.count("MapInArrow") for p in plans] == [1]
    monkeypatch.undo()
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in quality.scores(docs, labels).where("predicted = 1").collect())


def test_quality_model_is_the_textbook_one():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, quality.N)), rng.normal(0.5, 2, (200, quality.N))])
    y = np.repeat([0, 1], [300, 200])
    model = quality.fit(*quality.moments(x, y), pooled=0.0, ridge=0.0)
    logs = []
    for c in (0, 1):
        own = x[y == c]
        cov, d = np.cov(own.T, bias=True), x - own.mean(axis=0)
        logs.append(np.log(len(own) / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.log_odds(x), logs[1] - logs[0])


def plain_features(text):
    """The statistics, counted letter by letter and word by word."""
    raw, own = (text or "").encode(), [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    out = [np.log1p(len(raw)), np.log1p(len(own)), np.log1p(len(raw) / max(1, len(own)))]
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!#$%&*+=@^_~<>{}[]/\\", b"|", b"'\"()-", b" \t\n\x0b\x0c\r", b"\n", bytes(range(128, 256))]
    out += [np.sqrt(sum(raw.count(bytes([c])) for c in kind) / (len(raw) + 200)) for kind in kinds]
    pairs = list(zip(own, own[1:]))
    out += [np.sqrt((len(x) - len(set(x))) / (len(own) + 40)) for x in (own, pairs)]
    return out


def test_quality_against_brute_force(spark, awkward):
    """op4 from plain counts and the written formula, shrinkage on, over awkward texts too."""
    rng = random.Random(15)
    rows = [(n, junk(rng, rng.randint(1, 60)) if n % 3 == 0 else prose(rng, rng.randint(1, 60)) + rng.choice(["", "\nx|y", " É?", "  12"]), "s") for n in range(100, 400)]
    docs = documents(spark, rows).unionByName(awkward)
    labels = [(n, int(n % 3 != 0)) for n in range(100, 400)] + [(5, 1), (5, 1), (7, 0), (2, 1)]
    got = Counter((r.doc_id, r.held_out, round(r.score, 6), r.predicted) for r in quality.scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    every = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    x = np.array([plain_features(t) for _, t in every])
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in every]
    known = dict(labels)
    train = [k for k, (d, _) in enumerate(every) if d in known and not held[k]]
    y = np.array([known[every[k][0]] for k in train])
    mean, std = x[train].mean(axis=0), x[train].std(axis=0)
    z = (x - mean) / np.where(std < 1e-5, 1, std)
    own = [z[train][y == c] for c in (0, 1)]
    covs = [np.cov(o.T, bias=True) for o in own]
    both = sum(c * len(o) for c, o in zip(covs, own)) / len(train)
    logs = []
    for o, c in zip(own, covs):
        c = (1 - quality.POOLED) * c + quality.POOLED * both
        c = (1 - quality.RIDGE) * c + quality.RIDGE * np.trace(c) / len(c) * np.eye(len(c))
        d = z - o.mean(axis=0)
        logs.append(np.log(len(o) / len(train)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    score = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))
    assert got == Counter((d, h, round(float(s), 6), int(s >= 0.3)) for (d, _), h, s in zip(every, held, score))


def test_threshold_includes_ties(spark, monkeypatch):
    monkeypatch.setattr(quality, "THRESHOLD", 0.5)
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, [(1, "a", "s"), (2, None, "s")])
    assert {(r.score, r.predicted) for r in quality.scores(docs, none).collect()} == {(0.5, 1)} and quality.keep_good(docs, none, 0.5).count() == 2


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 50)
    labels = spark.createDataFrame([(n, n % 2) for n in range(1000)] + [(7, 1)] * 500, "doc_id long, quality int")
    assert 20 <= quality.training_rows(labels).count() <= 100


# -- lines --------------------------------------------------------------------------------------


def brute_lines(rows, ratio):
    pages = Counter(s for _, _, s in rows)
    found = Counter((s, ln) for _, t, s in rows for ln in {x.strip(" ") for x in (t or "").split("\n")} if ln and t is not None)
    bad = {k for k, n in found.items() if n - 1 > pages[k[0]] * ratio}
    out = []
    for i, t, s in rows:
        kept = [x for x in (t or "").split("\n") if (s, x.strip(" ")) not in bad]
        out.append((i, None if t is None else "\n".join(kept), s, 0 if t is None else len(t.split("\n")) - len(kept)))
    return sorted(out, key=repr)


def test_lines(spark, awkward, nothing, monkeypatch):
    rng = random.Random(5)
    rows = [(n, "\n".join([rng.choice(["menu ", " menu", "menu"]), prose(rng, 5), rng.choice(["foot", "own"]), ""]), rng.choice(["a", "a", "a", "b", None])) for n in range(120)]
    rows += [(n, "menu", "b") for n in range(200, 300)] + [(1, "menu\nmenu\nx", "a")] * 3 + [(500, None, "a"), (501, "", "a"), (None, "menu\nleft", "a")]
    rows += [(600, "only page\nof its host", "lone"), (601, "pair\nx", "two"), (602, "pair\ny", "two")]
    docs = documents(spark, rows).withColumn("lines_dropped", F.lit("old"))
    for ratio in (0.02, 0.5, 0.0):
        for most in (1_000_000, 0):  # sets broadcast, and joined by shuffles
            monkeypatch.setattr(lines, "SET_ROWS", most)
            got = lines.drop_boilerplate(docs, ratio=ratio)
            assert sorted(collected(got.select("doc_id", "text", "source", "lines_dropped")), key=repr) == brute_lines(rows, ratio)
            assert got.count() == len(rows)
    texts = {r.doc_id: r.text for r in lines.drop_boilerplate(docs).where("doc_id >= 600").collect()}
    assert texts == {600: "only page\nof its host", 601: "x", 602: "y"}
    assert got.columns == [*documents(spark, []).columns, "lines_dropped"] and got.select("k", "h", "line").distinct().count() == 1
    assert lines.drop_boilerplate(awkward).count() == awkward.count()
    assert lines.drop_boilerplate(nothing).count() == 0


# -- near duplicates -------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_near(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    out = []
    for i, (d, _, _) in enumerate(rows):
        none, first = least[find(i)]
        first = None if none else first
        out.append((d, len(sets[i]), first, d == first))
    return sorted(out, key=repr)


def chains(rng, groups, length):
    """Texts that drift: neighbours are alike, ends aren't."""
    rows, at = [], 1000
    for _ in range(groups):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 120))]
        for _ in range(length):
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
            rows.append((at, " ".join(words), "s"))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, star", [(2048, 1000), (4, 3)])
def test_near_duplicates(spark, awkward, nothing, monkeypatch, block, star):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    monkeypatch.setattr(setsketch, "PAIRS", 50 * block)
    monkeypatch.setattr(setsketch, "STAR", star)
    monkeypatch.setattr(setsketch, "BROADCAST_ROWS", 0 if block == 4 else 1000)
    rows = chains(random.Random(block), 12, 20) + [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()]
    got = collected(setsketch.near_duplicates(documents(spark, rows)))
    assert sorted(got, key=repr) == brute_near(rows)


def test_blocks_of_a_key_compare_every_pair_once(spark, monkeypatch):
    """One key in blocks of 3 gives the pairs that it gives in one block."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**64, 60, np.uint64)
    sets = [np.unique(np.concatenate((base, rng.integers(0, 2**64, 25, np.uint64)))) for _ in range(40)]
    rows = [(n, n, len(s), r.tobytes()) for n, (s, r) in enumerate(zip(sets, setsketch.registers(sets)))]
    classes = spark.createDataFrame(rows, "node long, c1 long, n long, registers binary")
    roots = spark.createDataFrame([(n, n // 2 * 2) for n in range(40)], "node long, comp long")
    out = []
    for block in (2048, 3):
        monkeypatch.setattr(setsketch, "BLOCK", block)
        out.append(sorted(collected(setsketch.cross_pairs(classes, roots))))
    assert out[0] == out[1] and len(out[0]) == len(set(out[0])) > 100
    assert all(a < b and a // 2 != b // 2 for a, b in out[0])


def test_rows_without_ids_do_not_multiply(spark, monkeypatch):
    """A third of the rows has no doc_id: each text is fetched once."""
    rng = random.Random(14)
    rows = [(None if n % 3 == 0 else n, prose(rng, 30) + (" same tail" if n % 2 else ""), "s") for n in range(300)]
    rows += [(None, rows[0][1] + " more", "s"), *rows[:1] * 20]
    seen, inner = [], setsketch.written
    monkeypatch.setattr(setsketch, "written", lambda df, name: seen.append((name, inner(df, name))) or seen[-1][1])
    docs = documents(spark, rows)
    assert sorted(collected(setsketch.near_duplicates(docs)), key=repr) == brute_near(rows)
    told = setsketch._told(docs).dropDuplicates(["rid", "rid2"])
    for name, wanted in seen:
        if name == "wanted":
            assert told.join(wanted, ["rid", "rid2"]).count() == wanted.count()
    assert setsketch.keep_one(docs).count() == 300


def test_near_duplicates_of_nothing(nothing):
    assert setsketch.near_duplicates(nothing).count() == setsketch.keep_one(nothing).count() == 0


def test_keep_one(spark, awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()]
    kept = setsketch.keep_one(awkward)
    assert kept.columns == awkward.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    base = next(t for d, t, _ in rows if d == 5)
    assert got[(5, base)] == 1 and got[(None, base)] == 0 and got[(7, "one two")] == 1 and got[(8, "one two")] == 0
    assert got[(6, base + " tail")] == 0 and got[(1, None)] == got[(2, "")] == got[(3, "   \n ")] == got[(None, None)] == 1
    assert sum(got.values()) == len(rows) - 4


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 3000, np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[800:])
    ra, rb, ru = setsketch.registers([a, b, np.union1d(a, b)])
    assert (setsketch.merged(ra, rb) == ru).all()
    j = setsketch.likely_similarity(np.array([2000.0]), np.array([2200.0]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))
    assert abs(j[0] - 0.4) < 0.2


# -- mixing ------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, awkward, nothing):
    rng = random.Random(8)
    rows = [(n, prose(rng, rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for n in range(300)] + [(7, "same text here", "b")] * 20
    rows += [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()]
    docs = documents(spark, rows)
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, len(WORD.findall(t or "")), sizes[s]) for i, t, s in rows)
    by_size = {(sizes[s], round(t, 6)) for s, t in want.items()}
    assert {(r.source_size, round(r.target, 6)) for r in got} == by_size
    taken = defaultdict(int)
    for r in got:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[(r.source_size, round(r.target, 6))] += r.taken
    largest = {sizes[s]: max(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in sizes}
    assert all(abs(taken[k] - k[1]) <= largest[k[0]] / 2 + 1 for k in by_size)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_counts(docs.repartition(3)).collect()))
    mixed = mixing.mix(docs, partitions=4)
    assert mixed.columns == [*docs.columns, "mix_position", "mix_copy"] and {r[0] for r in mixed.select("position").collect()} == {"x"}
    out = mixed.select("doc_id", "text", F.col("mix_position").alias("position"), F.col("mix_copy").alias("copy")).collect()
    copies = Counter((r.doc_id, r.text) for r in out)
    first = defaultdict(int)
    for i, t, _ in rows:
        first[(i, t)] = len(WORD.findall(t or ""))
    words = defaultdict(int)
    for r in got:
        words[r.doc_id] += r.taken
    assert {d: n for d, n in words.items() if n} == {d: n for d, n in ((d, sum(copies[k] * first[k] for k in copies if k[0] == d)) for d in {k[0] for k in copies})}
    assert [r.position for r in out] == sorted(r.position for r in out) and all(0 <= r.position <= 1 for r in out)
    assert mixing.mix_counts(nothing).count() == mixing.mix(nothing).count() == 0


def test_counts_are_those_of_the_mix(spark, awkward, nothing, monkeypatch):
    rng = random.Random(18)
    rows = [(n, prose(rng, rng.randint(0, 40)), rng.choice(["a", "a", "b", "c", None])) for n in range(200)] + [(7, "same text here", "b")] * 20
    docs = documents(spark, rows + [tuple(r) for r in awkward.select("doc_id", "text", "source").collect()])
    rounded = lambda df: sorted(repr((*r[:-1], r[-1] is not None and round(r[-1], 9))) for r in df.collect())
    assert rounded(mixing.mixed_counts(docs)) == rounded(mixing.mix_counts(docs))
    with monkeypatch.context() as m:
        m.setattr(mixing, "SOURCES", 0)  # no texts dropped before the shuffle
        assert rounded(mixing.mixed_counts(docs)) == rounded(mixing.mix_counts(docs))
    assert mixing.mixed_counts(nothing).count() == 0
    inner = mixing._mixed
    monkeypatch.setattr(mixing, "_mixed", lambda *args: inner(*args).where("doc_id <> 7"))  # a mix that lacks a document
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert {(r.taken, r.copies) for r in queries.op6_mixing(spark, "").where("doc_id = 7").collect()} == {(0, 0)}


def test_training_positions_invert_the_integral(spark):
    places = [k / 50 for k in range(51)]
    for nth, knots in enumerate(mixing.SCHEDULES):
        rows = spark.createDataFrame([(p,) for p in places], "p double").select(mixing.training_position(F.col("p"), F.lit(nth)).alias("t"))
        times = sorted(r.t for r in rows.collect())
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        weight = lambda t: np.interp(t, *zip(*knots))  # noqa: B023, E731
        for p, t in zip(places, times):
            grid = np.linspace(0, t, 4001)
            assert abs(np.trapezoid(weight(grid), grid) / area - p) < 1e-6


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc's allocator")
def test_workers_keep_no_memory_of_a_task(spark, monkeypatch):
    """What the sketches' and the filter's Python passes leave behind in a worker, which lives on beside the next stages."""
    anonymous = lambda: sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon")) >> 10
    rng = random.Random(4)
    docs = spark.createDataFrame([(1, prose(rng, 50))], "doc_id long, text string")
    passes, kind = [], type(docs)
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, run, *schema: passes.append(run) or plain(df, run, *schema))
    setsketch.sketches(docs)
    quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    bpe.digests(docs, tokenizer_file("word_bpe_49k.json"))
    assert len(passes) == 4  # the filter has two
    texts = [prose(rng, 300) for _ in range(10_000)]
    columns = {0: ["doc_id", "rid", "rid2", "text"], 1: ["text", "y"], 2: ["doc_id", "text"], 3: ["doc_id", "text"]}

    def used(run, names):
        for _ in run(iter([pa.RecordBatch.from_arrays([pa.array(texts) if n == "text" else pa.array(np.zeros(len(texts), np.int64)) for n in names], names=names)])):
            pass

    for k, run in enumerate(passes):
        used(run, columns[k])  # tables and caches stay
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        before = anonymous()
        used(run, columns[k])
        assert anonymous() < before + 8, columns[k]


def test_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", None, "b" * 50, "", "c", "d" * 7]})
    for size in (1, 5, 60, 1000):
        out = list(parts(batch, 0, size))
        assert pa.Table.from_batches(out).to_pydict() == batch.to_pydict() and all(p.num_rows for p in out)
    assert list(parts(batch.slice(0, 0), 0)) == []
