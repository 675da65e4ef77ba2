"""Nearest documents by shared authorities against all pairs."""

import math
import random
from collections import Counter

import pytest

from lexspark.operators import neighbours as N


def plain(docs, k):
    df = Counter(a for _, c in docs for a in set(c))
    n = sum(bool(c) for _, c in docs)
    w = {a: math.floor(1000 * math.log((n + 1) / x)) for a, x in df.items()}
    out = []
    for i, c in docs:
        scores = sorted((-sum(w[a] for a in set(c) & set(d)), j) for j, d in docs if j != i and set(c) & set(d))
        out += [(i, r, j, -s) for r, (s, j) in enumerate([x for x in scores if x[0] < 0][:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
def test_against_all_pairs(spark, most):
    rng = random.Random(most)
    docs = []
    for i in range(150):
        c = [f"hot{rng.randrange(4)}" for _ in range(rng.randrange(0, 4))] + [f"warm{rng.randrange(25)}" for _ in range(rng.randrange(0, 3))]
        docs.append((i, (c + [f"rare{rng.randrange(200)}"] if rng.random() < 0.5 else c) + (["everyone"] if i % 2 else [])))
    docs += [(1000 + i, docs[7][1] or ["hot0"]) for i in range(30)] + [(2000, [])]
    df = spark.createDataFrame(docs, "doc_id long, citations array<string>")
    got = sorted(tuple(r) for r in N.nearest_by_authorities(df, 4, most=most).collect())
    assert got == plain(docs, 4)


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(0)
    docs = [(i, [f"a{rng.randrange(9)}" for _ in range(3)]) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, citations array<string>")
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    assert sorted(tuple(r) for r in N.nearest_by_authorities(df, 3, most=2).collect()) == plain(docs, 3)
    assert N.nearest_by_authorities(df.limit(0), 3).collect() == []


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """A task's share of the pairs is bounded, whatever the bytes before the join; results stay (F2)."""
    rng = random.Random(5)
    docs = [(i, [f"a{rng.randrange(12)}" for _ in range(3)] + [f"hot{rng.randrange(3)}"]) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, citations array<string>")
    monkeypatch.setattr(N, "PAIRS", 500)
    sizes, plain_kept = [], N.kept

    def kept(x, name):
        if name == "found":
            sizes.append(x.rdd.getNumPartitions())
        return plain_kept(x, name)

    monkeypatch.setattr(N, "kept", kept)
    assert sorted(tuple(r) for r in N.nearest_by_authorities(df, 3, most=25).collect()) == plain(docs, 3)
    assert sizes[0] >= 5
