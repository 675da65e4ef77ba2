"""Flagship query: preprocess the legal corpus, profile it per language."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.preprocess import ALL_SECTIONS, preprocess
from .legal import legal


def flagship(spark, sf_dir):
    df = preprocess(legal(spark, sf_dir), "text", F.col("language"))
    return df.groupBy("language").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count(F.col(s)).alias(f"with_{s}") for s in ALL_SECTIONS],
        F.sum(F.size("citations")).cast("bigint").alias("citations"),
        F.sum(F.length("processed_text")).cast("bigint").alias("processed_chars"),
    ).orderBy("language")
