"""CIT-10/12: citation table and citation graph.

Graph aggregates are computed per key with partial (map-side) aggregation,
so a hot authority cited by a third of all documents collapses to one row
per map task before the shuffle. Doc-pair lists are never materialised
(quadratic in a hot key); the co-citation profile gives, per document, the
number of partner incidences computed arithmetically from in-degrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..session import kept
from .skew import salted_join


def citation_table(df: DataFrame, id_col: str = "doc_id", cit_col: str = "citations") -> DataFrame:
    """One row per (doc, ordinal, citation); documents without citations vanish."""
    t = explode_rows(df, F.col(cit_col), "citation", [id_col], pos_alias="ordinal")
    return t.select(id_col, F.col("ordinal").cast("bigint").alias("ordinal"), "citation")


def citation_edges(df: DataFrame, id_col: str = "doc_id", cit_col: str = "citations") -> DataFrame:
    """Edges doc → authority with multiplicity."""
    return (explode_rows(df, F.col(cit_col), "authority", [id_col])
            .groupBy(id_col, "authority").agg(F.count(F.lit(1)).alias("weight")))


def authority_stats(df: DataFrame, id_col: str = "doc_id", cit_col: str = "citations") -> DataFrame:
    e = citation_edges(df, id_col, cit_col)
    return e.groupBy("authority").agg(F.count(F.lit(1)).alias("in_degree"),
                                      F.sum("weight").alias("citations"))


def top_authorities(df: DataFrame, id_col: str = "doc_id", cit_col: str = "citations", k: int = 20) -> DataFrame:
    """Top-k authorities by in-degree (distinct citing docs), then total citations."""
    s = authority_stats(df, id_col, cit_col)
    return s.orderBy(F.desc("in_degree"), F.desc("citations"), F.asc("authority")).limit(k)


def co_citation_profile(df: DataFrame, id_col: str = "doc_id", cit_col: str = "citations") -> DataFrame:
    """Per document: distinct authorities, Σ(in_degree − 1) = number of
    (partner doc, shared authority) incidences, and the largest partner set
    of one authority. Edges are kept as a table, so that the texts are read
    once; those of a hot authority are dealt to several tasks."""
    e = kept(citation_edges(df, id_col, cit_col).select(id_col, "authority"), "edges")
    s = e.groupBy("authority").agg(F.count(F.lit(1)).alias("in_degree"))
    j = salted_join(e, s, "authority", [id_col])
    return j.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_authorities"),
        F.sum(F.col("in_degree") - 1).alias("shared_incidences"),
        F.max(F.col("in_degree") - 1).alias("max_partners"))
