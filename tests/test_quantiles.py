"""Exact quantiles against sorting, profiles against one pass over the data."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lexspark.operators import quantiles as Q
from lexspark.operators import sketches as SK


def linear(xs, q):
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    low = xs[int(at)]
    return low + (xs[min(len(xs) - 1, int(at) + (at > int(at)))] - low) * (at - int(at))


def test_quantiles_of_odd_groups(spark):
    rng = random.Random(1)
    groups = {"same": [3.0] * 50, "one": [-7.5], "two": [1.0, 2.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(999)],
              "zeros": [0.0] * 40 + [-1e-300, 1e-300, 5.0], "ints": [float(rng.randrange(20)) for _ in range(500)], None: [rng.gauss(0, 1) for _ in range(400)],
              "endless": [float("inf"), 1.0, float("inf"), 2.0, float("-inf"), 3.0, 4.0, 5.0], "ends": [-1.7e308, 1.7e308, 0.5, -0.5, 3.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("ints", None), ("none", None), ("ints", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["n"], r["a"], r["b"], r["c"]) for r in Q.exact_quantiles(df, "x", ["g"], [0.0, 0.37, 1.0], ["a", "b", "c"]).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and (got[g][1], got[g][3]) == (min(xs), max(xs))
        assert got[g][2] == pytest.approx(linear(xs, 0.37), rel=1e-12)


def test_a_million_distinct_doubles(spark):
    df = spark.range(1_000_000).select(F.expr("exp(pmod(id * 7919, 1000003) / 2000.0)").alias("x"))
    got = Q.exact_quantiles(df, "x", [], [0.25, 0.5, 0.75], ["a", "b", "c"]).first()
    xs = sorted(r[0] for r in df.collect())
    assert got["n"] == 1_000_000
    assert [got[c] for c in "abc"] == [pytest.approx(linear(xs, q), rel=1e-12) for q in (0.25, 0.5, 0.75)]


def test_merged_profiles(spark):
    rng = random.Random(3)
    rows = [(f"2026-01-01 {i % 20:02d}:10:00", rng.choice(["a", "b", None]), None if i % 7 == 0 else rng.gauss(5, 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "t string, s string, x double").withColumn("ts", F.to_timestamp("t"))
    p = SK.profile(df, "ts", ["s", "x"])
    assert p.count() == 40
    m = {r["column"]: r for r in SK.merged(p).collect()}
    xs = [r[2] for r in rows if r[2] is not None]
    assert m["x"]["rows"] == 2000 and m["x"]["completeness"] == pytest.approx(len(xs) / 2000)
    assert m["x"]["mean"] == pytest.approx(statistics.mean(xs)) and m["x"]["std"] == pytest.approx(statistics.stdev(xs))
    assert m["s"]["distinct"] == 2 and m["s"]["mean"] is None and m["s"]["quantile_sketch"] is None
    drift = SK.sketch_drift(p, F.hour("window_start") < 10, 5).collect()
    assert [r["bin"] for r in sorted(drift, key=lambda r: r["bin"])] == [0, 1, 2, 3, 4]
    assert all(abs(r["p"] - 0.2) < 0.04 for r in drift) and drift[0]["psi"] < 0.1
    assert SK.merged(p.limit(0)).collect() == []
