"""Exact quantiles by selection (AGG-05): histograms of a range are refined until
the wanted order statistics are alone in theirs. Each pass reads the input once
and keeps at most ``BUCKETS`` counts for a group and rank, however many distinct
values there are; a range that spans magnitudes is cut by logarithm, one that
holds zero by sign and one with an infinite end at it, so that a handful of passes is enough for any doubles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

BUCKETS = 4096


def _bucket(x: Column, lo: Column, hi: Column) -> Column:
    """Number of the part of [lo, hi] that holds x, rising with x."""
    def part(y: Column, a: Column, b: Column) -> Column:
        return F.least(F.greatest(F.floor((y - a) / (b - a) * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))

    top = F.lit(float("inf"))
    return (F.when(lo == hi, F.lit(0))
            .when((hi == top) | (lo == -top), F.when(x == top, 1).when(x == -top, -1).otherwise(0))
            .when((lo <= 0) & (hi >= 0), F.signum(x).cast("long"))
            .when((lo > 0) & (hi / 2 > lo), part(F.ln(x), F.ln(lo), F.ln(hi)))
            .when((hi < 0) & (lo / 2 < hi), part(-F.ln(-x), -F.ln(-lo), -F.ln(-hi)))
            .otherwise(part(x / 2, lo / 2, hi / 2)))  # halves: the span itself may pass the largest double


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def order_statistics(df: DataFrame, x: Column | str, by: list[str], ranks: DataFrame) -> DataFrame:
    """``by``, rank, value: the values at 0-based ranks of each group's order. ``ranks``: (``by``, rank),
    a few for each group. Null and NaN values are left out; ranks beyond a group have no row."""
    x = F.col(x) if isinstance(x, str) else x
    rows = df.select(*by, x.cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ends = rows.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    open_ = kept(ranks.join(ends, _on(ranks, ends, by)).select(*[ranks[k] for k in by], ranks["rank"], ranks["rank"].alias("_left"), "_lo", "_hi"), "ranks")
    done = None
    while True:
        found = open_.where("_lo = _hi").select(*by, "rank", F.col("_lo").alias("value"))
        done = found if done is None else done.unionByName(found)
        todo = open_.where("_lo < _hi")
        if todo.isEmpty():
            return done
        inside = rows.join(todo, _on(rows, todo, by) & rows["_x"].between(todo["_lo"], todo["_hi"])).select(
            *[todo[k] for k in by], "rank", "_left", "_x", _bucket(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("_b"))
        counts = inside.groupBy(*by, "rank", "_left", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_before", before).where((F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n")))
        open_ = kept(counts.select(*by, "rank", (F.col("_left") - F.col("_before")).alias("_left"), "_lo", "_hi"), "ranks")


def exact_quantiles(df: DataFrame, x: Column | str, by: list[str], quantiles: list[float], names: list[str]) -> DataFrame:
    """``by``, n and a column for each quantile, interpolated between neighbours in order. A group
    without values has no row."""
    x = F.col(x) if isinstance(x, str) else x
    value = x.cast("double")
    sizes = kept(df.groupBy(*by).agg(F.count(F.when(~F.isnan(value), value)).alias("n")).where("n > 0"), "ranks")
    at = [F.lit(q) * (F.col("n") - 1) for q in quantiles]
    ranks = sizes.select(*by, F.explode(F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)]))).alias("rank"))
    values = order_statistics(df, x, by, ranks)
    j = sizes.join(values, _on(sizes, values, by)).select(*[sizes[k] for k in by], "n", "rank", "value")

    def quantile(p: Column, name: str) -> Column:
        low, high = (F.max(F.when(F.col("rank") == f(p).cast("long"), F.col("value"))) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * F.max(p - F.floor(p))).alias(name)

    return j.groupBy(*by, "n").agg(*[quantile(p, name) for p, name in zip(at, names)])
