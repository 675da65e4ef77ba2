"""Filters and projections (FLT-01..09, PRJ-01..07).

All are narrow transformations (pushed to the Parquet scan where they touch
plain columns) except the allow-list / score joins, which are semi/inner
joins whose strategy Spark picks from runtime sizes (AQE turns them into
broadcast joins when the small side really is small).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import salted_join


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filter_task(df: DataFrame, task: str, col: str = "metadata.task") -> DataFrame:
    """FLT-01: keep one task; a missing task never matches."""
    return df.where(F.col(col) == task)


def filter_language(df: DataFrame, language: str, col: str = "metadata.language") -> DataFrame:
    """FLT-02."""
    return df.where(F.col(col) == language)


def filter_courts(df: DataFrame, courts: list[str], col: str = "court") -> DataFrame:
    """FLT-03 (our definition): court name starts with any listed token."""
    cond = reduce(lambda a, b: a | b, [F.col(col).startswith(c) for c in courts])
    return df.where(cond)


def filter_years(df: DataFrame, years: list, col: str = "date") -> DataFrame:
    """FLT-04: first four characters of the yyyyMMdd date in the list."""
    return df.where(F.substring(F.col(col), 1, 4).isin([str(y) for y in years]))


def filter_doc_types(df: DataFrame, types: list[str], col: str = "document_type") -> DataFrame:
    """FLT-05: exact match."""
    return df.where(F.col(col).isin(types))


def filter_cases(df: DataFrame, jurisdiction: str, start: str, end: str,
                 jurisdiction_col: str = "jurisdiction", date_col: str = "date") -> DataFrame:
    """FLT-06: jurisdiction and decision date in [start, end] (yyyy-MM-dd)."""
    d = F.try_to_timestamp(F.col(date_col), F.lit("yyyyMMdd")).cast("date")
    return df.where((F.col(jurisdiction_col) == jurisdiction)
                    & d.between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def take_docs(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """FLT-07: deterministic cap (total order, then limit → TakeOrderedAndProject)."""
    return df.orderBy(*order_by).limit(n)


def filter_authorised(df: DataFrame, allow, col: str = "source") -> DataFrame:
    """FLT-08: keep rows whose ``col`` is on the allow-list (a Python list →
    IN literal; a DataFrame with column ``col`` → left-semi join)."""
    if isinstance(allow, (list, tuple, set)):
        return df.where(F.col(col).isin(list(allow)))
    return df.join(allow.select(col).distinct(), on=col, how="left_semi")


def filter_quality(df: DataFrame, scores: DataFrame, min_score, id_col: str = "doc_id",
                   score_col: str = "quality") -> DataFrame:
    """FLT-09: keep examples whose judged score reaches ``min_score``."""
    good = scores.where(F.col(score_col) >= min_score).select(id_col, score_col)
    return df.join(good, id_col, "inner")


def with_metadata_defaults(df: DataFrame, fields: list[str], constants: dict | None = None,
                           default: str = "unknown") -> DataFrame:
    """PRJ-01: missing metadata → 'unknown'; add constant fields."""
    out = df
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f).cast("string"), F.lit(default)))
    for k, v in (constants or {}).items():
        out = out.withColumn(k, F.lit(v))
    return out


def with_file_metadata(df: DataFrame, path_col: str = "source_file", language: str = "en") -> DataFrame:
    """PRJ-02: extension without the dot, language constant."""
    return (df.withColumn("file_type", F.regexp_extract(F.col(path_col), r"\.([^./]+)$", 1))
            .withColumn("language", F.lit(language)))


def merge_catalogue(docs: DataFrame, catalogue: DataFrame, key: str,
                    fields: list[str]) -> DataFrame:
    """PRJ-03: catalogue values overwrite parsed metadata for matched docs.
    Documents that share a key are dealt to several tasks."""
    cat = catalogue.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_cat_{f}") for f in fields],
                           F.lit(True).alias("_matched"))
    j = salted_join(docs.withColumn("_k", F.col(key)), cat, "_k", docs.columns[:1], "left")
    for f in fields:
        base = F.col(f) if f in docs.columns else F.lit(None).cast("string")
        j = j.withColumn(f, F.when(F.col("_matched"), F.col(f"_cat_{f}")).otherwise(base))
    return j.drop("_k", "_matched", *[f"_cat_{f}" for f in fields])


def with_doc_stats(df: DataFrame, text_col: str, section_cols: list[str]) -> DataFrame:
    """PRJ-06: text length (code points) and number of present sections."""
    n = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in section_cols])
    return df.withColumn("text_length", F.length(F.col(text_col))).withColumn("num_sections", n)


def with_decision_date(df: DataFrame, col: str = "date") -> DataFrame:
    """PRJ-07: typed date from yyyyMMdd; 'Unknown' / malformed → NULL."""
    d = F.try_to_timestamp(F.col(col), F.lit("yyyyMMdd")).cast("date")
    return df.withColumn("decision_date", d).withColumn("decision_year", F.year(d))


truncate_text = T.truncate_text
path_key = T.path_key
