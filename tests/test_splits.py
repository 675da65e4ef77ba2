"""Splits: exact sizes, disjointness, coverage, agreement with a brute-force
sort of the seeded hash."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import splits as SP


def _h(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def _brute(ids, ratios=(0.8, 0.1, 0.1)):
    order = sorted(ids, key=lambda i: (_h(i), i))
    n = len(order)
    n_train = math.floor(ratios[0] * n)
    n_val = math.floor((n - n_train) * (ratios[1] / (ratios[1] + ratios[2])))
    lab = {}
    for pos, i in enumerate(order):
        lab[i] = "train" if pos < n_train else "validation" if pos < n_train + n_val else "test"
    return lab


def test_split_matches_brute_force(spark):
    ids = list(range(5003))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r["id"]: r["split"] for r in SP.split_dataset(df, "id").collect()}
    assert got == _brute(ids)


def test_stratified_split_sizes_and_one_member_stratum(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(999)] + [(5000, "solo"), (5001, None), (5002, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    out = SP.split_dataset(df, "id", stratify_by="s").collect()
    assert len(out) == len(rows) and len({r["id"] for r in out}) == len(rows)
    for s in ("a", "b", "solo", None):
        ids = [r[0] for r in rows if r[1] == s]
        got = {r["id"]: r["split"] for r in out if r["s"] == s}
        assert got == _brute(ids)


def test_two_way_and_ratios(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "id long")
    c = {r["split"]: r["count"] for r in SP.split_two_way(df, "id", 0.9).groupBy("split").count().collect()}
    assert c == {"train": 90, "validation": 11}
    with pytest.raises(ValueError):
        SP.check_ratios(0.8, 0.1, 0.2)


def test_global_rank_and_batches(spark):
    ids = list(range(777))
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    ranks = {r["id"]: r["rank"] for r in SP.global_rank(df, "id").collect()}
    order = sorted(ids, key=lambda i: (_h(i), i))
    assert ranks == {i: p for p, i in enumerate(order)}
    b = SP.with_batch_id(df, "id", 100).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in b) == [77] + [100] * 7


def test_temporal_split(spark):
    df = spark.createDataFrame([(1, 2019), (2, 2020), (3, 2021), (4, None)], "id long, year int")
    got = {r["id"]: r["split"] for r in SP.temporal_split(df).collect()}
    assert got == {1: "train", 2: "validation", 3: "test", 4: "train"}


def test_mix_quotas(spark):
    rows = [(i, "x") for i in range(100)] + [(1000 + i, "y") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, c string")
    got = {r["c"]: r["count"] for r in SP.mix(df, "id", "c", {"x": 0.8, "y": 0.2}).groupBy("c").count().collect()}
    # N = min(100/0.8, 10/0.2) = 50 → 40 x, 10 y
    assert got == {"x": 40, "y": 10}


def test_variants_and_capture_are_repeatable(spark):
    df = spark.createDataFrame([(i,) for i in range(2000)], "id long")
    a = SP.assign_variant(df, "id", {"A": 0.7, "B": 0.3}).groupBy("variant").count().collect()
    share = {r["variant"]: r["count"] / 2000 for r in a}
    assert abs(share["A"] - 0.7) < 0.05
    assert SP.capture_sample(df, "id", 100).count() == 2000
    s1 = {r["id"] for r in SP.capture_sample(df, "id", 25).collect()}
    s2 = {r["id"] for r in SP.capture_sample(df, "id", 25).collect()}
    assert s1 == s2 and 350 < len(s1) < 650


def test_bucket_by_length_batches_are_bounded(spark):
    df = spark.createDataFrame([(i, (i * 37) % 1000) for i in range(500)], "id long, n int")
    out = SP.bucket_by_length(df, "n", "id", 8, bucket_width=100, salt_buckets=4)
    sizes = out.groupBy("length_bucket", "salt", "batch_no").agg(F.count("*").alias("c")).collect()
    assert max(r["c"] for r in sizes) <= 8 and sum(r["c"] for r in sizes) == 500


def test_hash_split_is_narrow_and_close_to_ratios(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    out = SP.hash_split(df, "k")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    c = {r["split"]: r["count"] / 20000 for r in out.groupBy("split").count().collect()}
    assert abs(c["train"] - 0.8) < 0.02 and abs(c["validation"] - 0.1) < 0.02 and abs(c["test"] - 0.1) < 0.02


def test_batches_by_budget(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, 7, 7, 7, 7, 30, 64, 65, 1000])) for i in range(700)] + [(700, None)]
    df = spark.createDataFrame(rows, "id long, n long")
    got = SP.batch_by_budget(df, "n", "id", 64).collect()
    assert len(got) == 701
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r["n"] or 0)
    assert sorted(batches) == list(range(len(batches)))
    short = 0
    for b, ns in sorted(batches.items()):
        most = max(1, 64 // max(1, max(ns)))
        assert len(ns) <= most
        short += len(ns) < most
        assert b == 0 or max(ns) <= min(batches[b - 1])
    assert short <= 1
    assert SP.batch_by_budget(df.limit(0), "n", "id", 64).collect() == []
