"""Lexical search, collocations and language model against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexspark.llm import collocations, fptree, pitmanyor, tokens
from tests.llm.conftest import CLASHING, values

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = [r[1] for r in rows]
    return spark.createDataFrame([(1, texts[0][:200]), (2, texts[1]), (2, texts[1]), (3, None), (4, ""), (5, "THE the the zzzzzz"), (6, "!?"), (None, texts[2]), (7, "日本語 a a a b")], "item_id long, text string")


def plain_search(rows, items, k):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    docs = [(r[0], Counter(t)) for r in rows if (t := terms(r[1]))]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in docs) + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_search(docs, rows, items):
    pairs = [tuple(r) for r in items.collect()]
    got = fptree.search(docs, items, 4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert values(got) == plain_search(rows, pairs, 4)
    more = docs.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING + ["terms", "tfs", "item", "item_id", "n"]])
    assert values(fptree.search(more, items.selectExpr("*", "1 AS number", "2 AS h"), 4)) == values(got)


def test_search_of_nothing(docs, no_docs, items):
    assert fptree.search(no_docs, items).collect() == []
    assert fptree.search(docs, items.limit(0)).collect() == []


def test_search_in_blocks_of_items(docs, items, monkeypatch):
    want = values(fptree.search(docs, items, 4))
    monkeypatch.setattr(fptree, "ITEM_TERMS", 40)
    assert values(fptree.search(docs, items, 4)) == want


@pytest.mark.parametrize("leaf, depth", [(1, 3), (2, 24), (5, 2), (64, 24)])
def test_branch_and_bound_loses_nothing(leaf, depth, monkeypatch):
    monkeypatch.setattr(fptree, "LEAF", leaf)
    monkeypatch.setattr(fptree, "DEPTH", depth)
    rng = np.random.default_rng(leaf)
    n, v = 300, 40
    tf = rng.poisson(0.15, (n, v)) * rng.integers(1, 4, (n, v))
    tf[100:140] = tf[100]  # copies
    m = rng.integers(25, 300, n)
    m[100:140] = 77
    rank = np.argsort(np.argsort(-(tf > 0).sum(axis=0), kind="stable")).astype(np.int32)
    doc, term = np.nonzero(tf)
    tree = fptree.Tree(np.searchsorted(doc, np.arange(n + 1)), term, tf[doc, term], m, rank)
    weight = rng.integers(0, 5000, (12, v)) * (rng.random((12, v)) < 0.3)
    weight[:, 0] += 1
    item, asked = np.nonzero(weight)
    best = fptree._Best(fptree.Items.of(list(range(12)), item, asked, weight[item, asked], v), 10)
    ids = [None if d % 50 == 0 else d // 2 for d in range(n)]
    best.search(tree, ids)
    part = np.where(tf > 0, 10**9 * tf // (1000 * tf + 8 * m[:, None]), 0)
    for i, s in enumerate(weight @ part.T):
        assert best.found[i] == sorted((-int(x), ids[d] is None, ids[d] or 0) for d, x in enumerate(s) if x > 0)[:10]


# ------------------------------------------------------------------ collocations

def plain_phrases(rows, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\n-\r]", (r[1] or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in good.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], a)
        kept = []
        for p, a in good.items():
            if len(p) == 2 and 100 * longest[p] >= cover * a:
                continue
            score, cut = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, cover, top", [(10, 50, 2000), (2, 50, 30), (3, 90, 10)])
def test_collocations(docs, rows, least, cover, top):
    got = collocations.best_phrases(docs, top, least=least, cover=cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert values(got) == plain_phrases(rows, least, cover, top)


def test_collocations_take_any_table(docs, no_docs, clashing):
    assert collocations.best_phrases(no_docs).collect() == []
    more = clashing.selectExpr("*", "1 AS w1", "2 AS f", "3 AS phrase")
    assert values(collocations.best_phrases(more, least=3)) == values(collocations.best_phrases(docs, least=3))


def test_phrases_over_the_edges_of_chunks(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 9)
    texts = ["a b c d e f g h i j k l m n o p q, r s", None, "t", "a b c d. e f"] * 3
    batches = [pa.record_batch([pa.array(texts[i:i + 2]), pa.array(["x", None][:1] * len(texts[i:i + 2]))], names=["text", "lang"]) for i in range(0, len(texts), 2)]
    every = np.full(1 << 10, -1, np.int64).view(np.uint64)
    for size in (2, 3):
        got = Counter()
        for b in collocations._count_runs(size, 0, every, 3)(iter(batches)):
            cols = [b.column(c).flatten().to_numpy() for c in [*collocations._names(size), "n"]]
            for *w, n in zip(*cols):
                got[tuple(w)] += int(n)
        want = Counter()
        for b in batches:
            t, _, _ = collocations._keyed(b, 0)
            key = list(zip(t.row.tolist(), t.piece.tolist()))
            for i in range(len(key) - size + 1):
                if key[i] == key[i + size - 1]:
                    want[tuple(t.hash[i:i + size].view(np.int64).tolist())] += 1
        assert got == want


def test_scores_are_exact(spark):
    rows = [(10**15 + 7, 10**15 + 9, 10**15 + 13), (3, 7, 11), (10**12, 10**12, 10**12)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocations._score("a", "l", "r")).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


# ------------------------------------------------------------------ language model

def test_counts_and_base_score(docs, rows):
    def fold(i):
        return zlib.crc32(str(i).encode()) % 3

    def words(text):
        return re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER)) + [None]

    c = Counter(w for r in rows if r[0] is not None and fold(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], r[0] is not None and fold(r[0]) == 0, len(w := words(r[1])), sum(c[x] > 0 for x in w), n,
                    round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for r in rows), key=repr)
    got = pitmanyor.score(docs, folds=3, contexts=5).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score < 0 for r in got)


def test_model_takes_any_table(docs, no_docs, clashing):
    assert pitmanyor.score(no_docs).collect() == []
    more = clashing.selectExpr("*", "1 AS number", "2 AS learned", "3 AS owner")
    a, b = (sorted(((*r[:5], round(r.base_score, 6)) for r in pitmanyor.score(d).collect()), key=repr) for d in (docs, more))
    assert a == b


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    contexts, n = 4, 60
    sizes = np.full(n, contexts + 2)
    counts = rng.poisson(0.7, n * (contexts + 2))
    p = pitmanyor.Pairs(np.arange(n).astype(np.uint64), sizes, np.tile(np.arange(contexts + 2), n), counts)
    tables, root = (counts > 0).astype(int), (p.by_word(counts) > 0).astype(int)
    for sweep in range(3):
        x = pitmanyor._shared(p, tables, root, contexts)
        s = pitmanyor.Totals(x[contexts + 2:2 * contexts + 4], x[:contexts + 2], int(x[-7]), int(x[-6]), 0.6, 0.4, int(x[-5]))
        probs = pitmanyor.probability(p, tables, root, s, contexts).reshape(n, -1)
        known = p.by_word(counts) > 0
        unknown = pitmanyor.parent_probability(np.zeros(1), np.zeros(1), s)[0]
        for u in range(contexts + 2):
            share = unknown if u == contexts else (1.0 + 0.6 * s.tables[u]) * unknown / (1.0 + s.customers[u])
            assert math.isclose(probs[known, u].sum() + share, 1, rel_tol=1e-9)
        tables, root = pitmanyor._sweep(p, tables, root, s, contexts, rng)
        assert ((tables >= (counts > 0)) & (tables <= counts))[p.contexts != contexts].all()


def test_seating_follows_its_law():
    """Tables of five customers: weights by all seatings, (theta + d tables) P for a new table and size - d for one in use."""
    base, others, d, c = 0.05, 40, 0.5, 5
    law = Counter()

    def sit(sizes, weight):
        if sum(sizes) == c:
            law[len(sizes)] += weight
            return
        sit([*sizes, 1], weight * (pitmanyor.STRENGTH + d * (others + len(sizes))) * base)
        for i, x in enumerate(sizes):
            sit([*sizes[:i], x + 1, *sizes[i + 1:]], weight * (x - d))

    sit([1], 1.0)
    got = Counter(pitmanyor.seated(np.full(40000, c), base, others, d, np.random.default_rng(2), draws=32).tolist())
    for t in range(1, c + 1):
        assert abs(got[t] / 40000 - law[t] / sum(law.values())) < 0.015
    many = pitmanyor.seated(np.full(300, 5000), base, others, d, np.random.default_rng(3))
    assert 5 < many.mean() < 5000 and (many >= 1).all()


def test_held_out_texts_are_less_surprising_than_by_counts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = pitmanyor.perplexity(pitmanyor.score(d)).collect()
    assert {r.held_out for r in scored} == {True, False}
    assert all(r.perplexity < r.base_perplexity for r in scored)


def test_chunks_change_no_counts(monkeypatch):
    """Requests of small chunks add up to those of one."""
    class At:
        def partitionId(self):
            return 0

    monkeypatch.setattr(pitmanyor.TaskContext, "get", staticmethod(lambda: At()))
    texts = ["a b a c a b " * 20, "", None, "b b", "c a"]
    batch = pa.record_batch([pa.array([4, 5, 6, None, 8]), pa.array(texts), pa.array([False] * 5), pa.array([True, True, True, False, True])], names=["doc_id", "text", "held_out", "learned"])
    known = np.sort(tokens.tokens_of(pa.array(["a"]), pitmanyor.WORD).hash)
    found = []
    for size in (7, 50, 1 << 21):
        monkeypatch.setattr(pitmanyor, "CHUNK", size)
        rows = [r for b in pitmanyor._requests(known, np.zeros(1, np.int64), 3)(iter([batch, batch])) for r in b.to_pylist()]
        p = pitmanyor.Pairs.merged([pitmanyor.Pairs.of(r) for r in rows if r["owner"] >= 0])
        n = Counter()
        for r in rows:
            for x in r["ids"] or []:
                n[x["number"], x["doc_id"]] += x["n_tokens"]
        found.append((p.words.tolist(), p.sizes.tolist(), p.contexts.tolist(), p.counts.tolist(), n))
    assert found[0] == found[1] == found[2]


def test_every_context_has_a_restaurant(spark):
    """Words after infrequent words are as likely as if these were frequent ones (before: as likely as after any word)."""
    pairs = [(f"q{i} z{i}", f"z{i} q{(i * 7 + 3) % 40}") for i in range(40)]
    texts = [f"x x x {a} x {b} x {a}" for a, b in pairs for _ in range(6)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    few, all_ = ({r.doc_id: r.score for r in pitmanyor.score(d, contexts=n, samples=4).collect()} for n in (1, 200))
    assert sum(abs(few[i] - all_[i]) for i in few) / len(few) < 0.3


def test_totals_of_infrequent_contexts_meet_across_owners(spark, monkeypatch):
    """Scores hardly change with the number of owners."""
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 200)) for i in range(200)], "doc_id long, text string").repartition(3)
    one = {r.doc_id: r.score for r in pitmanyor.score(d, contexts=10, samples=4).collect()}
    monkeypatch.setattr(pitmanyor, "OWNED", 1500)
    many = {r.doc_id: r.score for r in pitmanyor.score(d, contexts=10, samples=4).collect()}
    assert sum(abs(one[i] - many[i]) / abs(one[i]) for i in one) / len(one) < 0.01
