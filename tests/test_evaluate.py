"""Metrics on hand-computed cases and brute-force references."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import evaluate as EV


def test_lcs_against_dynamic_programming():
    rnd = random.Random(7)

    def dp(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        assert EV._lcs_len(a, b) == dp(a, b)


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame([
        ("a", "the cat sat on the mat", "the cat on the mat"),
        ("b", "x y", ""),
        ("c", "Hello, World!", "hello world"),
    ], "id string, reference string, prediction string")


def test_rouge_hand_computed(spark, pairs):
    r = {x["id"]: x for x in EV.rouge_n(pairs, "id", "reference", "prediction", (1, 2)).collect()}
    # ref unigrams 6, pred 5, clipped overlap 5 → P=1, R=5/6
    assert r["a"]["rouge1"] == pytest.approx(2 * 1 * (5 / 6) / (1 + 5 / 6))
    # bigrams: ref 5, pred 4, overlap {the cat, on the, the mat} = 3 → P=.75, R=.6
    assert r["a"]["rouge2"] == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    assert r["b"]["rouge1"] == 0.0 and r["c"]["rouge1"] == pytest.approx(1.0)
    rl = {x["id"]: x["rougeL"] for x in EV.rouge_l(pairs, "id", "reference", "prediction").collect()}
    assert rl["a"] == pytest.approx(2 * 1 * (5 / 6) / (1 + 5 / 6)) and rl["b"] == 0.0


def test_bleu_hand_computed(spark, pairs):
    r = {x["id"]: x["bleu"] for x in EV.bleu(pairs, "id", "reference", "prediction").collect()}
    # p1=5/5, p2=3/4, p3=1/3 ("on the mat"), p4=0→0.1/2, BP=exp(1-6/5)
    expect = math.exp(1 - 6 / 5) * math.exp((math.log(1) + math.log(0.75) + math.log(1 / 3) + math.log(0.1 / 2)) / 4)
    assert r["a"] == pytest.approx(expect)
    assert r["b"] == 0.0
    assert r["c"] == 0.0  # whitespace tokens, case-sensitive: no unigram match


def test_classification_metrics(spark):
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("C", "B"), ("A", "A")]
    df = spark.createDataFrame(rows, "true_label string, predicted_label string")
    assert EV.accuracy(df).first()["accuracy"] == pytest.approx(0.6)
    w = EV.weighted_prf(df).first()
    # A: P=1 R=2/3 F=.8 (3); B: P=1/3 R=1 F=.5 (1); C: 0 (1)
    assert w["precision"] == pytest.approx((3 * 1 + 1 / 3) / 5)
    assert w["recall"] == pytest.approx((3 * 2 / 3 + 1) / 5)
    assert w["f1"] == pytest.approx((3 * 0.8 + 0.5) / 5)
    cm = {(r["true_label"], r["predicted_label"]): r["n"] for r in EV.confusion(df, dense=True).collect()}
    assert len(cm) == 9 and cm[("C", "C")] == 0 and cm[("A", "A")] == 2 and cm[("C", "B")] == 1


def test_extract_label(spark):
    df = spark.createDataFrame([("this document falls under Contract Law because",),
                                ("Basierend auf meiner Analyse fällt dieses Dokument in die Kategorie Strafrecht, weil",),
                                ("nothing",), (None,)], "t string")
    en = [r["l"] for r in df.select(EV.extract_label("t", "en").alias("l")).collect()]
    de = [r["l"] for r in df.select(EV.extract_label("t", "de").alias("l")).collect()]
    ref = [r["l"] for r in df.select(EV.extract_label("t", "de", "reference").alias("l")).collect()]
    assert en == ["Contract", "unknown", "unknown", "unknown"]
    assert de[1] == "Strafrecht" and ref[1] == "unknown"


def test_auc_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([0.1, 0.2, 0.5, 0.7, 0.9, rnd.random()]), rnd.randint(0, 1)) for _ in range(800)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y != 1]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert EV.auc(df, buckets=16).first()["auc"] == pytest.approx(brute)


def test_evaluate_by_task_long_form(spark):
    df = spark.createDataFrame([
        ("1", "classification", "this document falls under A because", "this document falls under A because"),
        ("2", "classification", "this document falls under B because", "this document falls under A because"),
        ("3", "summarization", "a b c", "a b"),
        ("4", "case_analysis", "x y", "x y"),
    ], "id string, task string, reference string, prediction string")
    s = EV.score_pairs(df)
    m = {r["metric"]: r["value"] for r in EV.evaluate_by_task(s).collect()}
    assert m["classification_accuracy"] == pytest.approx(0.5)
    assert m["case_analysis_rouge1"] == pytest.approx(1.0)
    assert "summarization_bleu" in m and "case_analysis_bleu" not in m


def test_targets_and_checkpoints(spark):
    m = spark.createDataFrame([("reasoning_accuracy", 0.85), ("latency_seconds", 6.0)], "metric string, value double")
    t = {r["metric"]: r["passed"] for r in EV.check_targets(m).collect()}
    assert t == {"reasoning_accuracy": True, "latency_seconds": False}
    log = spark.createDataFrame([("step 1 train_loss: 0.5",), ("validation_accuracy: 0.75 x",), ("noise",)], "line string")
    got = sorted((r["metric"], r["value"]) for r in EV.parse_log_metrics(log).collect())
    assert got == [("train:loss", 0.5), ("validation:accuracy", 0.75)]
    ck = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.3)], "step int, loss double")
    b = EV.best_checkpoint(ck, "step", "loss").first()
    assert (b["best_step"], b["best_loss"]) == (2, 0.3)


def test_ngrams_are_counted_within_pairs(spark):
    """Against plain counting; rows of one id are one pair of several texts, and n-grams are no rows of the plan."""
    from collections import Counter

    rows = [("a", "the cat sat on the mat the cat", "the cat the cat sat"), ("b", "", "x y"), ("c", None, None), ("d", "x y z", "z y x"), ("d", "y z w", "x y z"), (None, "n n", "n")]
    df = spark.createDataFrame(rows * 20, "id string, reference string, prediction string").where("id IS NULL OR id <> 'b'").unionByName(
        spark.createDataFrame(rows[1:2], "id string, reference string, prediction string"))
    d = df.select("id", EV.whitespace_tokens("reference").alias("r"), EV.whitespace_tokens("prediction").alias("p"))
    st = EV.gram_stats(d, ["id"], [("k", "r", "p", (1, 2, 4))])
    got = {x["id"]: x.asDict() for x in st.collect()}
    pairs = {}
    for i, r, p in [x for x in rows if x[0] != "b"] * 20 + rows[1:2]:
        pairs.setdefault(i, []).append((r, p))
    assert set(got) == set(pairs)
    for i, texts in pairs.items():
        for n in (1, 2, 4):
            r, p = (Counter(tuple(w[k:k + n]) for t in texts for w in [(t[side] or "").split()] for k in range(len(w) - n + 1)) for side in (0, 1))
            assert (got[i][f"k_h{n}"], got[i][f"k_r{n}"], got[i][f"k_p{n}"]) == (sum((r & p).values()), sum(r.values()), sum(p.values()))
    assert "gram#" not in st._jdf.queryExecution().executedPlan().toString()
