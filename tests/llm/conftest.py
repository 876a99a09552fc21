"""Small awkward tables."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, line string, key string, size string, node string, position string, score string, part string, ids string, rank string"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """rows of (doc_id, text, source); the further columns clash with names inside the operators."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * 11) for i, t, s in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 80)
    rows = [(n, prose(rng, 60), f"s{n % 3}") for n in range(10, 40)]
    rows += [(1, None, "s0"), (2, "", "s1"), (3, "   \n ", None), (None, base, "s0"), (None, None, None), (4, prose(rng, 60_000), "s2"), (5, base, "s0"), (5, base, "s0"), (5, prose(rng, 30), "s0"), (6, base + " tail", "s1"), (7, "one two", "s0"), (8, "one two", "s0"), (9, "x" * 100_000, "s0")]
    return documents(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
