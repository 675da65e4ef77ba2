"""Searches against brute force."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lexspark.llm import mtree, permutation
from lexspark.llm.vectors import sampled
from tests.llm.conftest import values

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=600, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 2, (n, 1))
    x[200:400] = x[200]  # a third of all rows are one vector
    x[450:460] = 0
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1020, [None] + [1.0] * (dim - 1), 0), (1040, [math.nan] * dim, 0), (1060, [math.inf] * dim, 0), (None, [1.0] * dim, 0), (1100, [], 0)]
    return rows + [rows[0], rows[0]]


def brute(rows, every, k, score, zero):
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}
    out = []
    for q in sorted(good):
        if q % every == 0:
            best = sorted(((-score(good[q], v), i) for i, v in good.items() if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_exact_topk(spark, monkeypatch, small):
    if small:  # many routing objects, several subtrees below one, deep ones
        for name, value in (("CELL", 20), ("PAGE", 4), ("FAN", 3), ("AHEAD", 2), ("SLICE", 3)):
            monkeypatch.setattr(mtree, name, value)
        monkeypatch.setattr(mtree, "rows_of", lambda megabytes, width: 10)
    rows = vectors()
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute(rows, 50, 5, lambda a, b: int(np.floor(256 * a) @ np.floor(256 * b)), zero=True)
    assert values(mtree.search(d)) == sorted(want, key=repr)


def test_exact_topk_of_few_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, [0.5, 0.5], 1), (7, [0.5, 0.5], 1)], SCHEMA)
    assert values(mtree.search(d)) == [(0, 1, 7, 128 * 256), (0, 2, 50, 128 * 256), (50, 1, 0, 128 * 256), (50, 2, 7, 2 * 128 * 128)]


def test_clustered_vectors_spare_computations():
    """Nodes have radii, entries their distances: on clusters, few are computed, and none is missed."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (40, 16))
    v = np.unique((centres[rng.integers(0, 40, 8000)] + rng.integers(-40, 41, (8000, 16))).astype(float), axis=0)
    top = float(np.sqrt((v * v).sum(axis=1).max()))
    rows = pa.table({"vid": np.arange(len(v)), "v": list(v)})
    made = mtree._grown(top, permutation._lifted(v[:1], top))((pa.scalar(0), pa.scalar(0)), rows).sort_by("node")
    tree = mtree._built(top)(made)
    assert sorted(made.filter(pc.equal(made["child"], -1))["vid"].to_pylist()) == list(range(len(v)))
    for e in made.to_pylist():  # a radius covers all vectors below
        if e["child"] >= 0:
            below, todo = [], [e["child"]]
            while todo:
                n = todo.pop()
                for i in range(tree.begin[n], tree.begin[n + 1]):
                    (below if tree.child[i] < 0 else todo).append(tree.vid[i] if tree.child[i] < 0 else tree.child[i])
            far = np.linalg.norm(permutation._lifted(v[below], top) - permutation._lifted(np.array([e["v"]]), top), axis=1)
            assert far.max() <= e["radius"] + 1e-6
    asked = v[::200]
    for q in asked:
        far = mtree._distances(permutation._lifted(q[None], None), permutation._lifted(v[:1], top))[0, 0]
        vid, s = tree.best(q, far, np.inf, 6)
        want = sorted((-float(q @ x), i) for i, x in enumerate(v))[:6]
        assert [(-a, b) for a, b in zip(s, vid)] == want
    assert tree.computed < 0.5 * len(v) * len(asked)


def test_footrule_by_inverted_files():
    """Sums over the files are the footrule distances of the orders."""
    rng = np.random.default_rng(2)
    order = np.array([rng.permutation(20)[:8] for _ in range(50)])
    block = permutation.Block(np.arange(50), np.zeros((50, 2)), order, 20)
    for q in order[:10]:
        near = block.nearness(q)
        for i, o in enumerate(order):
            place = lambda x, p: list(x).index(p) if p in x else 8
            assert sum(abs(place(q, p) - place(o, p)) for p in range(20)) == 8 * 9 - 2 * int(near[i])


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_sample_by_hash(spark, n):
    d = spark.range(n).withColumnRenamed("id", "vid")
    assert sampled(d, n, 30).count() == min(n, 30)


def test_nearest_of_all_candidates_is_exact(spark):
    """With every vector scored the answers are those of brute force, ties and copies included."""
    rows = vectors()
    found = permutation.search(spark.createDataFrame(rows, SCHEMA).repartition(4), share=1.0).collect()
    want = brute(rows, 20, 20, lambda a, b: round(float(a @ b), 9), zero=False)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found if r["query_id"] not in range(200, 400)) == [w[:3] for w in want if w[0] not in range(200, 400)]
    assert len(found) == len(want)
    exact = {(w[0], w[1]): w[3] for w in want}
    assert all(r["score"] == pytest.approx(exact[r["query_id"], r["rank"]]) for r in found)


def test_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in d.collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 20, lambda a, b: float(a @ b), zero=False)}
    found = {(r["query_id"], r["vec_id"]) for r in permutation.search(d).collect()}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)


@pytest.mark.parametrize("search", [mtree.search, permutation.search])
def test_empty_and_further_columns(spark, search):
    assert search(spark.createDataFrame([], SCHEMA)).collect() == []
    d = spark.createDataFrame(vectors(dim=6)[:500], SCHEMA)
    more = d.selectExpr("*", "1 AS v", "2 AS vid", "3 AS rank", "4 AS score", "5 AS cell", "6 AS ids", "7 AS query_id", "8 AS block")
    assert values(search(more)) == values(search(d))
