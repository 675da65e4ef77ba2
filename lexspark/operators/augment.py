"""Augmentation (AUG-01..04).

Case variants are one ``explode`` over an array built per row (original +
jurisdiction variants + year variants) — a narrow Generate, no union, no
join. Synonym replacement explodes only the ≤ n chosen word positions per
document, joins them to the caller's synonym table and folds the choices
back by document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.arrays import explode_rows
from .skew import salted_join
from .splits import hash_key

_VARIANT = "struct<variant:string,text:string,jurisdiction:string,year:int>"


def _jurisdiction_variants(text, jur, year):
    alts = F.filter(F.array(*[F.lit(j) for j in P.JURISDICTIONS]), lambda j: j != jur)
    return F.when(jur.isNull(), F.array().cast(f"array<{_VARIANT}>")).otherwise(F.transform(
        alts, lambda j: F.struct(F.concat(F.lit("jurisdiction:"), j).alias("variant"),
                                 F.replace(text, F.concat(F.lit("jurisdiction of "), jur),
                                           F.concat(F.lit("jurisdiction of "), j)).alias("text"),
                                 j.alias("jurisdiction"), year.alias("year"))))


def _year_variants(text, jur, year):
    ys = F.filter(F.array(*[year + F.lit(s) for s in P.YEAR_SHIFTS]),
                  lambda y: (y > P.YEAR_MIN_EXCLUSIVE) & (y < P.YEAR_MAX_EXCLUSIVE))
    return F.when(year.isNull(), F.array().cast(f"array<{_VARIANT}>")).otherwise(F.transform(
        ys, lambda y: F.struct(F.concat(F.lit("year:"), y.cast("string")).alias("variant"),
                               F.replace(text, F.concat(F.lit("in "), year.cast("string")),
                                         F.concat(F.lit("in "), y.cast("string"))).alias("text"),
                               jur.alias("jurisdiction"), y.cast("int").alias("year"))))


def augment_cases(df: DataFrame, text_col: str = "text", jurisdiction_col: str = "jurisdiction",
                  year_col: str = "year", jurisdiction: bool = True, year: bool = True) -> DataFrame:
    """AUG-02..04: original + independent jurisdiction and year variants.
    Output keeps the other columns and replaces text/jurisdiction/year;
    ``variant`` names the change ('original' for the source row)."""
    t, j, y = F.col(text_col), F.col(jurisdiction_col), F.col(year_col).cast("int")
    parts = [F.array(F.struct(F.lit("original").alias("variant"), t.alias("text"),
                              j.alias("jurisdiction"), y.alias("year")))]
    if jurisdiction:
        parts.append(_jurisdiction_variants(t, j, y))
    if year:
        parts.append(_year_variants(t, j, y))
    others = [c for c in df.columns if c not in (text_col, jurisdiction_col, year_col)]
    ex = explode_rows(df, F.concat(*parts), "_v", others)
    return ex.select(*others, F.col("_v.variant").alias("variant"), F.col("_v.text").alias(text_col),
                     F.col("_v.jurisdiction").alias(jurisdiction_col), F.col("_v.year").alias(year_col))


def augment_synonyms(df: DataFrame, synonyms: DataFrame, id_col: str, text_col: str = "text",
                     n_words: int = 5, p_replace: float = 0.3, min_len: int = 4, seed=42) -> DataFrame:
    """AUG-01: choose min(n, #words) distinct word positions (seeded hash
    order); a chosen word of ≥ ``min_len`` chars is replaced with
    probability ``p_replace`` by one of its synonyms (seeded pick from the
    sorted list); words are re-joined by single spaces.
    ``synonyms``: (word, synonym) rows supplied by the caller; ids are distinct and not null."""
    words = F.split(F.trim(F.regexp_replace(F.col(text_col), P.WS, " ")), " ")
    d = df.select(F.struct(*[F.col(c) for c in df.columns if c != text_col]).alias("_row"), F.col(id_col).alias("_id"),
                  F.when(F.trim(F.col(text_col)) == "", F.array().cast("array<string>")).otherwise(words).alias("_w"))
    # rank positions per row in seeded order and keep the first n (per-row sort, no shuffle)
    keyed = F.transform("_w", lambda w, i: F.struct(hash_key([F.col("_id"), i], seed).alias("h"), i.alias("pos"), w.alias("word")))

    def draw(pos: Column, what: str) -> Column:
        return F.conv(F.substring(hash_key([F.col("_id"), pos, F.lit(what)], seed), 1, 8), 16, 10).cast("bigint")

    chosen = F.filter(F.slice(F.array_sort(keyed), 1, n_words),
                      lambda c: (F.length(c["word"]) >= min_len) & (draw(c["pos"], "p") / F.lit(4294967296.0) <= F.lit(p_replace)))
    # a row travels with the first of its chosen words, so that its text is read once
    picks = d.select("_id", F.struct("_row", "_w").alias("_all"), F.posexplode_outer(chosen).alias("_k", "_c"))
    picks = picks.select("_id", F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("_all")).alias("_all"), F.col("_c.pos").alias("pos"), F.col("_c.word").alias("word"))
    syn = synonyms.groupBy("word").agg(F.array_sort(F.collect_set("synonym")).alias("_syn"))
    j = salted_join(picks, syn, "word", ["_id", "pos"], "left")
    pick = F.element_at("_syn", (draw(F.col("pos"), "s") % F.size("_syn")).cast("int") + 1)
    j = j.withColumn("_r", F.when(F.col("_syn").isNotNull(), F.struct("pos", pick.alias("w"))))
    rows = j.groupBy("_id").agg(F.first("_all", ignorenulls=True).alias("_all"), F.map_from_entries(F.collect_list("_r")).alias("_rep"))
    new = F.transform("_all._w", lambda w, i: F.coalesce(F.try_element_at(F.col("_rep"), i), w))
    return rows.select(*[(F.array_join(new, " ") if c == text_col else F.col(f"_all._row.{c}")).alias(c) for c in df.columns])
