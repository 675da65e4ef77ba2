"""Driver queries over stored profiles: what sketches give, held against the exact values within their stated errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as SK
from ..session import read_table, scratch_folder
from .registry import query

_COLS = ["event_id", "user_id", "event_type", "value"]
_NUM = ["event_id", "user_id", "value"]
_CUT = "(SELECT quantile_disc(ts, 0.5) FROM events)"


def _profiles(spark, sf_dir):
    """Hourly profiles of the events, written once and read back."""
    path = scratch_folder(spark, "profiles")
    SK.profile(read_table(spark, sf_dir, "events"), "ts", _COLS).write.parquet(path)
    return spark.read.parquet(path)


def _exact(c: str, numeric: bool) -> str:
    x = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, round(count({c}) / count(*), 6) AS completeness, round(min({x}), 6) AS min, round(max({x}), 6) AS max, "
            f"round(avg({x}), 6) AS mean, round(stddev_samp({x}), 4) AS std, true AS distinct_ok, {'true' if numeric else 'CAST(NULL AS BOOLEAN)'} AS quantiles_ok FROM events")


@query("profile_baseline", " UNION ALL ".join(_exact(c, c in _NUM) for c in _COLS))
def profile_baseline(spark, sf_dir):
    """MON-01 by merging hourly rows: moments are exact, distinct counts within three standard
    errors, quantiles within twice the rank error."""
    base = SK.merged(_profiles(spark, sf_dir))
    probes = [0.25, 0.5, 0.75]
    told = base.withColumn("_q", F.when(F.col("numbers") > 0, F.array(*[SK.quantile("quantile_sketch", q) for q in probes])))
    events = read_table(spark, sf_dir, "events")
    long = events.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("s"), (F.col(c).cast("double") if c in _NUM else F.lit(None).cast("double")).alias("x")) for c in _COLS])).alias("_c")).select("_c.*")
    seen = long.join(F.broadcast(told.select("column", "_q")), "column").groupBy("column").agg(  # a row per column
        F.countDistinct("s").alias("_d"), F.count("x").alias("_n"), *[F.count_if(F.col("x") < F.get("_q", F.lit(i))).alias(f"_lt{i}") for i in range(3)],
        *[F.count_if(F.col("x") <= F.get("_q", F.lit(i))).alias(f"_le{i}") for i in range(3)])
    near = [(F.col(f"_lt{i}") / F.col("_n") - 2 * SK.RANK_ERROR <= q) & (F.col(f"_le{i}") / F.col("_n") + 2 * SK.RANK_ERROR >= q) for i, q in enumerate(probes)]
    return told.join(seen, "column").select(
        "column", "rows", F.round("completeness", 6).alias("completeness"), *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")], F.round("std", 4).alias("std"),
        (F.abs(F.col("distinct") / F.col("_d") - 1) <= 3 * SK.DISTINCT_ERROR).alias("distinct_ok"), F.when(F.col("_n") > 0, near[0] & near[1] & near[2]).alias("quantiles_ok"))


@query("profile_drift", f"SELECT 'value' AS \"column\", CAST(i AS INTEGER) AS bin, true AS p_ok, true AS q_ok FROM (SELECT unnest(range(10)) AS i)")
def profile_drift(spark, sf_dir):
    """MON-03 by merging hourly rows: the shares of all bins are within the rank error of the exact ones."""
    p = _profiles(spark, sf_dir)
    cut = F.lit(p.agg(F.expr("percentile_approx(window_start, 0.5)")).first()[0])
    bins = SK.sketch_drift(p, F.col("window_start") < cut, 10).where(F.col("column") == "value")
    edges = sorted(r["edge"] for r in bins.select("edge").collect())  # ten
    e = read_table(spark, sf_dir, "events").where("value IS NOT NULL").select((F.window("ts", "1 hour")["start"] < cut).alias("_ref"), "value")
    e = e.withColumn("bin", F.array_position(F.transform(F.lit(edges), lambda x: F.col("value") <= x), F.lit(True)).cast("int") - 1)
    counts = e.groupBy("bin").agg(F.count_if("_ref").alias("_a"), F.count_if(~F.col("_ref")).alias("_b"))
    totals = e.agg(F.struct(F.count_if("_ref").alias("a"), F.count_if(~F.col("_ref")).alias("b"))).scalar()
    j = bins.join(counts, "bin", "left")

    def near(share, n, total):
        return (F.abs(F.col(share) - F.coalesce(F.col(n), F.lit(0)) / total) <= 4 * SK.RANK_ERROR).alias(f"{share}_ok")

    return j.select("column", "bin", near("p", "_a", totals["a"]), near("q", "_b", totals["b"]))
