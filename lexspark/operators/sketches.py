"""Mergeable profiles (MON-01, MON-03): a row per time window and column with
counts, moments and sketches (HLL for distinct values, KLL for quantiles). The
table is written once; baselines, quantile bins and drift of any span of windows
come from merging its rows, without the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12  # of HLL: 4,096 registers
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)  # relative standard error
KLL_K = 200
RANK_ERROR = 0.0165  # of KLL at this k, normalised, two-sided, at 99 percent


def profile(df: DataFrame, ts_col: str, columns: list[str], window: str = "1 hour") -> DataFrame:
    """window_start, column, rows, non_null, numbers, mean, m2, min, max, distinct_sketch,
    quantile_sketch (null without numbers): a row per window and column, mergeable by ``merged``."""
    types = dict(df.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def cell(c: str) -> Column:
        x = F.col(c).cast("double") if types[c] in numeric or types[c].startswith("decimal") else F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("s"), F.when(~F.isnan(x), x).alias("x"))

    long = df.select(F.window(ts_col, window)["start"].alias("window_start"), F.explode(F.array(*map(cell, columns))).alias("_c")).select("window_start", "_c.*")
    x = F.col("x")
    out = long.groupBy("window_start", "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("s").alias("non_null"), F.count(x).alias("numbers"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.hll_sketch_agg("s", LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(x, KLL_K).alias("quantile_sketch"))
    return out.withColumn("quantile_sketch", F.when(F.col("numbers") > 0, F.col("quantile_sketch")))


def merged(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of ``profile`` merged by column (and ``by``): column, rows, completeness, distinct, min,
    max, mean, std, quantile_sketch."""
    by = [*(by or []), "column"]
    n = F.col("numbers")
    g = profiles.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("non_null").alias("non_null"), F.sum(n).alias("numbers"), (F.sum(n * F.col("mean")) / F.sum(n)).alias("mean"),
        F.sum("m2").alias("_m2"), F.sum(n * F.col("mean") * F.col("mean")).alias("_between"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"), F.kll_merge_agg_double(F.col("quantile_sketch")).alias("quantile_sketch"))
    between = F.greatest(F.col("_between") - F.col("numbers") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return g.select(*by, "rows", (F.col("non_null") / F.col("rows")).alias("completeness"), "distinct", "min", "max", "mean",
                    F.when(F.col("numbers") > 1, F.sqrt((F.col("_m2") + between) / (F.col("numbers") - 1))).alias("std"), "numbers",
                    F.when(F.col("numbers") > 0, F.col("quantile_sketch")).alias("quantile_sketch"))


def quantile(sketch: Column | str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def sketch_drift(profiles: DataFrame, cut: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """MON-03 from stored profiles: column, bin, edge (its upper end), p, q, psi. Bins are quantiles of
    the windows where ``cut`` holds; p and q are the shares there and in the other windows."""
    sides = merged(profiles.withColumn("_ref", F.coalesce(cut, F.lit(False))), ["_ref"]).where("numbers > 0")
    both = sides.groupBy("column").agg(F.max(F.when(F.col("_ref"), F.col("quantile_sketch"))).alias("a"), F.max(F.when(~F.col("_ref"), F.col("quantile_sketch"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    inner = {r["column"]: list(r["_e"]) for r in both.select("column", F.array(*[quantile("a", i / bins) for i in range(1, bins)]).alias("_e")).collect()}  # a row per column
    out = None
    for c, edges in inner.items():  # ranks are taken at literals only
        ranks = {side: F.concat(F.array(F.lit(0.0)), F.kll_sketch_get_rank_double(side, F.lit(edges)), F.array(F.lit(1.0))) for side in "ab"}
        rows = both.where(F.col("column") == c).select("column", F.lit([*edges, float("inf")]).alias("_e"), *[r.alias(f"_{side}") for side, r in ranks.items()])
        rows = rows.select("column", "_a", "_b", F.posexplode("_e").alias("bin", "edge"))
        shares = [F.greatest(F.get(f"_{side}", F.col("bin") + 1) - F.get(f"_{side}", F.col("bin")), F.lit(floor)).alias(name) for side, name in (("a", "p"), ("b", "q"))]
        rows = rows.select("column", "bin", "edge", *shares)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return both.selectExpr("column", "0 AS bin", "0.0D AS edge", "0.0D AS p", "0.0D AS q", "0.0D AS psi").where("false")
    psi = out.groupBy("column").agg(F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("psi"))
    return out.join(psi, "column")
