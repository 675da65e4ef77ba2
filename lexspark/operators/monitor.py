"""Data-quality monitoring (MON-01..04, STR-02 batch twin).

Baselines are one-pass aggregates unpivoted to a long table; violations,
drift and variant comparison are grouped aggregates joined to that small
baseline (one row per column / bin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from .splits import assign_variant

_NUMERIC = (TY.ByteType, TY.ShortType, TY.IntegerType, TY.LongType, TY.FloatType, TY.DoubleType, TY.DecimalType)


def baseline(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """MON-01: per column: completeness, distinct count, min/max/mean/std
    (numeric only) and suggested constraints (completeness ≥ observed,
    numeric range [min, max]). Distinct counts default to HyperLogLog
    (``approx_count_distinct``: fixed-size state, one pass); ``exact=True``
    counts exactly, which expands every row once per column and shuffles
    the distinct values."""
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        num = isinstance(types[c], _NUMERIC)
        dc = F.countDistinct(F.col(c)) if exact else F.approx_count_distinct(F.col(c))
        aggs += [F.count(F.col(c)).alias(f"{c}__nn"), dc.alias(f"{c}__d"),
                 (F.min(F.col(c)).cast("double") if num else F.lit(None).cast("double")).alias(f"{c}__min"),
                 (F.max(F.col(c)).cast("double") if num else F.lit(None).cast("double")).alias(f"{c}__max"),
                 (F.avg(F.col(c)) if num else F.lit(None).cast("double")).alias(f"{c}__mean"),
                 (F.stddev_samp(F.col(c)) if num else F.lit(None).cast("double")).alias(f"{c}__std")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("type"),
        (F.col(f"{c}__nn") / F.col("_n")).alias("completeness"),
        F.col(f"{c}__d").cast("bigint").alias("distinct"),
        F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
        F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std")) for c in columns]))
    return one.select(F.col("_n").alias("rows"), rows.alias("_r")).select("rows", "_r.*")


def violation_counts(df: DataFrame, base: DataFrame, ts_col: str, columns: list[str], window: str = "1 hour") -> DataFrame:
    """w, column, b_completeness, rows, nn, out_of_range: the counts behind ``violations``, of a
    table or of a stream (a stream-static join with the baseline)."""
    w = F.window(F.col(ts_col), window)
    long = df.select(w.alias("w"), F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).isNull().alias("is_null"),
        F.col(c).cast("double").alias("x")) for c in columns])).alias("_v")).select("w", "_v.*")
    b = base.where(F.col("column").isin(columns)).select(  # a row per column
        "column", F.col("completeness").alias("b_completeness"), F.col("min").alias("b_min"), F.col("max").alias("b_max"))
    outside = (F.col("x") < F.col("b_min")) | (F.col("x") > F.col("b_max"))
    return long.join(F.broadcast(b), "column").groupBy("w", "column", "b_completeness").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((~F.col("is_null")).cast("long")).alias("nn"),
        F.count(F.when(outside, 1)).alias("out_of_range"))


def violation_result(counts: DataFrame) -> DataFrame:
    share = F.col("nn") / F.col("rows")
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "column", "rows",
                         share.alias("completeness"), "out_of_range", (share < F.col("b_completeness")).alias("completeness_violation"))


def violations(df: DataFrame, base: DataFrame, ts_col: str, columns: list[str],
               window: str = "1 hour") -> DataFrame:
    """MON-02: per time window and column: rows, completeness, values out of
    the baseline range, and whether completeness fell below the baseline."""
    return violation_result(violation_counts(df, base, ts_col, columns, window))


def drift(a: DataFrame, b: DataFrame, col: str, bins: int = 10, categorical: bool = False,
          floor: float = 1e-6) -> DataFrame:
    """MON-03: population-stability index Σ (p−q)·ln(p/q) between period a
    (reference) and b, over equal-width bins of a's range (or categories);
    shares floored at 1e-6. Output: per-bin shares plus the total as
    ``psi`` on every row."""
    x = F.col(col).cast("string") if categorical else F.col(col).cast("double")
    both = (a.select(x.alias("_x"), F.lit(1).alias("_a")).unionByName(b.select(x.alias("_x"), F.lit(0).alias("_a"))))
    if categorical:
        binned = both.select("_a", F.col("_x").alias("bin"))
    else:
        span = a.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
        binned = both.where(F.col("_x").isNotNull()).select("_a", _bin(F.col("_x"), span, bins).cast("string").alias("bin"))
    counts = binned.groupBy("bin").agg(F.sum("_a").alias("na"), F.sum(1 - F.col("_a")).alias("nb"))
    totals = counts.agg(F.struct(F.sum("na").alias("a"), F.sum("nb").alias("b"))).scalar()
    s = counts.select("bin", F.greatest(F.col("na") / totals["a"], F.lit(floor)).alias("p"),
                      F.greatest(F.col("nb") / totals["b"], F.lit(floor)).alias("q"))
    s = s.withColumn("term", (F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q")))
    return s.withColumn("psi", s.agg(F.sum("term")).scalar())


def _bin(x: Column, span: Column, bins: int) -> Column:
    """Number of the equal-width bin; values outside the span belong to its ends."""
    width = (span["hi"] - span["lo"]) / bins
    return F.when(span["hi"] == span["lo"], 0).otherwise(
        F.least(F.greatest(F.floor((x - span["lo"]) / width), F.lit(0)), F.lit(bins - 1)))


def compare_variants(df: DataFrame, id_cols, weights: dict, metrics: dict, seed=42) -> DataFrame:
    """MON-04: assign A/B variants by hash and aggregate metrics per variant."""
    v = assign_variant(df, id_cols, weights, seed)
    return v.groupBy("variant").agg(F.count(F.lit(1)).alias("rows"), *[e.alias(k) for k, e in metrics.items()])


def window_quality(df: DataFrame, ts_col: str, key_col: str, value_col: str, window: str = "1 hour") -> DataFrame:
    """STR-02 batch twin: per tumbling window and key: requests, mean,
    max and missing values."""
    return df.groupBy(F.window(F.col(ts_col), window).alias("w"), F.col(key_col)).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(value_col).alias("avg_value"),
        F.max(value_col).alias("max_value"), F.sum(F.col(value_col).isNull().cast("long")).alias("missing")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key_col, "requests",
             "avg_value", "max_value", "missing")

