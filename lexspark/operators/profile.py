"""Profiling aggregates (AGG-01..10, ANO-14, FLT-10/11).

All are single-pass hash aggregations with map-side partial aggregation;
totals for percentages come from a grouped window over the (small)
aggregated result, never from a driver round trip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import explode_rows
from .quantiles import exact_quantiles


def pii_report(df: DataFrame, text_col: str, lang, by: list[str]) -> DataFrame:
    """ANO-14: masking-rule hits per group (regexp_count on the text)."""
    c = T.pii_counts(F.col(text_col), lang)
    names = [f.name for f in df.select(c.alias("_c")).schema["_c"].dataType.fields]
    d = df.select(*by, c.alias("_c"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"),
                              *[F.sum(f"_c.{n}").cast("bigint").alias(n) for n in names])


def distribution(df: DataFrame, field: Column | str, by: list[str] | None = None,
                 name: str = "value") -> DataFrame:
    """AGG-01/02: count and percent (1 decimal) of a field; NULL → 'unknown'.
    ``by``: per-group distribution (e.g. per split)."""
    by = by or []
    f = F.col(field) if isinstance(field, str) else field
    g = df.groupBy(*by, F.coalesce(f.cast("string"), F.lit("unknown")).alias(name)).agg(
        F.count(F.lit(1)).alias("count"))
    if by:
        return g.withColumn("percent", F.round(F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(*by)), 1))
    total = g.agg(F.sum("count")).scalar()  # no window over all values in one task
    return g.select(*by, name, "count", F.round(F.col("count") * 100.0 / total, 1).alias("percent"))


def describe_lengths(df: DataFrame, length: Column | str, by: list[str] | None = None,
                     exact: bool = True) -> DataFrame:
    """AGG-05: count, mean, sample std, min, 25/50/75 % (linear), max.

    ``exact``: selection by refined histograms (``quantiles.exact_quantiles``), whose
    state is bounded however many distinct values there are. ``exact=False``
    uses ``percentile_approx`` (fixed-size sketch) in one pass."""
    by = by or []
    x = F.col(length) if isinstance(length, str) else length
    x = x.cast("double")
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    q = [] if exact else [F.percentile_approx(x, p, 10000).cast("double").alias(n) for n, p in names.items()]
    rows = df.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), *q)
    if exact:
        found = exact_quantiles(df, x, by, list(names.values()), list(names))
        rows = rows.join(found.select(*by, *names), reduce(lambda a, b: a & b, [rows[k].eqNullSafe(found[k]) for k in by], F.lit(True)), "left").select(*[rows[c] for c in rows.columns], *names)
    return rows.select(*by, "count", "mean", "std", "min", *names, "max")


def length_histogram(df: DataFrame, length: Column | str, bins: int = 20) -> DataFrame:
    """AGG-06: equal-width bins between min and max (a scalar subquery); the last bin is closed."""
    x = (F.col(length) if isinstance(length, str) else length).cast("double")
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    width = (span["hi"] - span["lo"]) / bins
    b = F.when(span["hi"] == span["lo"], F.lit(0)).otherwise(F.least(F.floor((x - span["lo"]) / width), F.lit(bins - 1))).cast("int")
    h = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select("bin", (span["lo"] + F.col("bin") * (span["hi"] - span["lo"]) / bins).alias("bin_start"),
                    (span["lo"] + (F.col("bin") + 1) * (span["hi"] - span["lo"]) / bins).alias("bin_end"), "count")


def section_counts(df: DataFrame, sections: list[str]) -> DataFrame:
    """AGG-04: documents having each section (one pass, then unpivot)."""
    agg = df.agg(*[F.count(F.col(s)).alias(s) for s in sections])
    return agg.unpivot([], sections, "section", "documents")


def task_counts(df: DataFrame, task: Column | str = "metadata.task") -> DataFrame:
    """AGG-03: examples per task (missing → 'unknown')."""
    t = F.col(task) if isinstance(task, str) else task
    return df.groupBy(F.coalesce(t, F.lit("unknown")).alias("task")).agg(F.count(F.lit(1)).alias("count"))


def catalogue_stats(df: DataFrame, dims: list[str]) -> DataFrame:
    """AGG-07: counts by each dimension separately, in one pass (GROUPING SETS).
    Output: one row per (dimension, value)."""
    sets = [[F.col(d)] for d in dims]
    g = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id(*[F.col(d) for d in dims]).alias("_gid"), F.count(F.lit(1)).alias("count"))
    n = len(dims)
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))  # only dimension i is grouped
        dim = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim)
        val = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(val)
    return g.select(dim.alias("dimension"), F.coalesce(val, F.lit("unknown")).alias("value"),
                    F.col("count").cast("bigint").alias("count"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """FLT-11: NULL (or empty) count per required field, one pass + unpivot."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), 1).otherwise(0))
                   .alias(f.replace(".", "_")) for f in fields])
    names = [f.replace(".", "_") for f in fields]
    long = agg.unpivot(["_n"], names, "field", "missing")
    return long.select("field", F.col("missing").cast("bigint").alias("missing"),
                       (F.col("_n") - F.col("missing")).cast("bigint").alias("present"),
                       F.round(1.0 - F.col("missing") / F.col("_n"), 6).alias("completeness"))


def adequacy(df: DataFrame, by: str, minimum: int, ideal: int) -> DataFrame:
    """FLT-10: size verdict and balance over ``by`` (largest/smallest share)."""
    g = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("k")).agg(
        F.count(F.lit(1)).alias("c"))
    a = g.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"),
              F.max("c").alias("max_c"), F.min("c").alias("min_c"))
    return a.select(
        F.col("n").cast("bigint").alias("examples"), F.col("groups").cast("bigint").alias("groups"),
        F.round(F.col("max_c") / F.col("n"), 6).alias("max_share"),
        F.round(F.col("min_c") / F.col("n"), 6).alias("min_share"),
        (F.col("n") >= minimum).alias("meets_minimum"), (F.col("n") >= ideal).alias("meets_ideal"),
        F.when(F.col("n") >= ideal, "ideal").when(F.col("n") >= minimum, "adequate")
        .otherwise("insufficient").alias("verdict"))


def mine_vocabulary(df: DataFrame, id_col: str, text_col: str, k: int,
                    token_regex: str = r"[^\p{L}\p{N}§.]+", min_len: int = 3) -> DataFrame:
    """AGG-09: term frequency and document frequency, top-k by document
    frequency. Tokens: split on anything but letters/digits/§/dot, strip
    trailing dots. Partial aggregation shrinks hot terms map-side."""
    toks = df.select(F.col(text_col).alias("_t"), F.col(id_col).alias("_d"))
    ex = explode_rows(toks, F.split(F.col("_t"), token_regex), "term", ["_d"])
    ex = ex.select("_d", F.regexp_replace("term", r"\.+$", "").alias("term")).where(
        F.length("term") >= min_len)
    per_doc = ex.groupBy("term", "_d").agg(F.count(F.lit(1)).alias("tf"))
    stats = per_doc.groupBy("term").agg(F.sum("tf").alias("term_freq"), F.count(F.lit(1)).alias("doc_freq"))
    return stats.orderBy(F.desc("doc_freq"), F.desc("term_freq"), F.asc("term")).limit(k)


def manifest(df: DataFrame, split_col: str = "split", field: str = "metadata.document_type") -> DataFrame:
    """AGG-08: per split: count, distribution of ``field`` ('value:count',
    sorted by value; NULL → 'unknown') and the record's field list."""
    fields = [c for c in df.columns if c != split_col]
    g = df.groupBy(split_col, F.coalesce(F.col(field).cast("string"), F.lit("unknown")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    m = g.groupBy(split_col).agg(F.sum("_c").cast("bigint").alias("count"),
                                 F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_d"))
    dist = F.array_join(F.transform("_d", lambda e: F.concat(e["_v"], F.lit(":"), e["_c"].cast("string"))), ",")
    return m.select(split_col, "count", dist.alias("distribution"),
                    F.array(*[F.lit(f) for f in fields]).alias("fields"))
