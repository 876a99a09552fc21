"""Each stage of the pipeline on what its predecessor wrote, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing, quality
from tessella.llm.common import written
from tessella.llm.queries import tokenizer_file
from tests.llm.conftest import documents, prose
from tests.llm.test_text_operators import WORD, brute_lines, brute_near, brute_targets, chains, junk

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, awkward):
    """name -> (rows before, rows after), each a list of dicts; and the last table's DataFrame."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(21)
    rows = [(n, junk(rng, rng.randint(20, 90)) if n % 4 == 0 else prose(rng, rng.randint(20, 90)) + "\nfooter of the site", f"s{n % 2}") for n in range(500, 800)]
    rows += [(i, t, s) for i, t, s in chains(rng, 5, 6)]
    docs = documents(spark, rows).unionByName(awkward)
    spark.createDataFrame([(n, int(n % 4 != 0), 0) for n in range(500, 800)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    out, docs = {}, written(docs, "test-docs")
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, at), f"test-{name}")
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], docs)
        docs = after
    return out, at


def count(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_columns(stages):
    for name, (_, after, _) in stages[0].items():
        assert set(after[0]) == (set(corpus_pipeline.COLUMNS) if name != "bpe" else {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "shard", "row"})


def test_quality(spark, stages):
    before, after, docs = stages[0]["quality"]
    scored = quality.scores(docs, spark.read.parquet(f"{stages[1]}/labels.parquet")).collect()  # held against brute force by itself
    good = Counter((r.doc_id, r.predicted) for r in scored)
    kept, all_ = count(after, "doc_id"), count(before, "doc_id")
    for (doc,), n in all_.items():
        assert kept[(doc,)] == good[(doc, 1)] and n == good[(doc, 0)] + good[(doc, 1)]
    assert count(after, *corpus_pipeline.COLUMNS) <= count(before, *corpus_pipeline.COLUMNS) and 0 < len(after) < len(before)


def test_lines(stages):
    before, after, _ = stages[0]["lines"]
    want = Counter((i, t, s) for i, t, s, _ in brute_lines([(r["doc_id"], r["text"], r["source"]) for r in before], 0.02))
    assert count(after, "doc_id", "text", "source") == want and any("footer" in (r["text"] or "") for r in before)
    assert not any("footer" in (r["text"] or "") for r in after)


def test_near_duplicates(stages):
    before, after, _ = stages[0]["near-dedup"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before]
    groups = {(i, f) for i, n, f, _ in brute_near(rows) if n}
    empty = sum(1 for _, n, _, _ in brute_near(rows) if not n)
    full = [r for r in after if WORD.findall(r["text"] or "")]
    assert len(after) - len(full) == empty and count(after, *corpus_pipeline.COLUMNS) <= count(before, *corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in full} == {f for _, f in groups} and len(full) == len({f for _, f in groups}) < len(rows) - empty


def test_mixing(stages):
    before, after, docs = stages[0]["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    words = lambda r: len(WORD.findall(r["text"] or ""))
    for r in before:
        sizes[r["source"]] += words(r)
    for r in after:
        taken[r["source"]] += words(r)
    largest = {s: max(words(r) for r in before if r["source"] == s) for s in sizes}
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1
    most = count(before, *corpus_pipeline.COLUMNS)
    assert all(n <= 3 * most[k] for k, n in count(after, *corpus_pipeline.COLUMNS).items())
    assert count(after, "doc_id", "text") == count([r.asDict() for r in mixing.mix(docs).collect()], "doc_id", "text")


def test_tokens_in_training_order(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    before, after, docs = stages[0]["bpe"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(r):
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        return r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))

    assert count(after, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == Counter(map(want, before))
    # by shard and row the tokens come in the order of the mix
    order = [r["doc_id"] for r in sorted(after, key=lambda r: (r["shard"], r["row"]))]
    _, _, unmixed = stages[0]["mixing"]
    assert order == [r.doc_id for r in mixing.mix(unmixed).orderBy("mix_position", "doc_id", "mix_copy").collect()]
    none = STAGES["bpe"](docs.sparkSession, docs.sparkSession.createDataFrame(docs.limit(3).collect(), docs.schema), stages[1])
    assert none.where(F.col("shard").isNull() & F.col("row").isNull()).count() == 3
