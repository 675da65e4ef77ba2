"""TXT-06: normalise → sections → citations → mask sections → join.

One narrow projection chain: no shuffle, no Python worker. The normalised
text is materialised once as its own column (Spark keeps it in a separate
Project instead of copying the regex into each of its ~12 consumers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

ALL_SECTIONS = ["header", "body", "conclusion", "tatbestand", "gruende", "tenor", "leitsaetze"]


def _lang_col(lang) -> Column:
    return F.lit(lang) if isinstance(lang, str) else lang


def _section_exprs(norm: Column, lang, fallback: bool) -> dict:
    lc = _lang_col(lang)
    out = {}
    for name, pat, grp in P.SECTIONS_EN:
        out[name] = F.when(lc == "en", F.trim(T._first_group(norm, pat, grp)))
    for name, pat, grp in P.SECTIONS_DE:
        out[name] = F.when(lc == "de", F.trim(T._first_group(norm, pat, grp)))
    return out


def with_sections(df: DataFrame, norm_col: str, lang, fallback: bool = True,
                  prefix: str = "") -> DataFrame:
    """Adds one column per section (NULL = absent). ``fallback``: no
    section found ⇒ ``body`` = whole text (SEC-08); off for SEC-09."""
    norm = F.col(norm_col)
    exprs = _section_exprs(norm, lang, fallback)
    df = df.select("*", *[e.alias(prefix + n) for n, e in exprs.items()])
    if fallback:
        any_found = F.greatest(*[F.col(prefix + n).isNotNull() for n in ALL_SECTIONS])
        df = df.withColumn(prefix + "body", F.when(~any_found, norm).otherwise(F.col(prefix + "body")))
    return df


def join_sections(prefix: str = "") -> Column:
    """SEC-10: present sections in declared order joined by a blank line;
    empty sections stay in the join, NULL (absent) ones are skipped."""
    return F.concat_ws("\n\n", *[F.col(prefix + n) for n in ALL_SECTIONS])


def preprocess(df: DataFrame, text_col: str = "text", lang="en", anonymize: bool = True,
               fallback: bool = True, keep_sections: bool = True) -> DataFrame:
    """Returns df + normalized_text, <sections...>, citations, processed_text.

    ``lang``: 'en' | 'de' | other (Python string) or a Column per row.
    Citations come from the normalised, unmasked text (reference order)."""
    df = df.withColumn("normalized_text", T.normalize(F.col(text_col), lang))
    df = with_sections(df, "normalized_text", lang, fallback=fallback)
    df = df.withColumn("citations", T.citations(F.col("normalized_text"), lang))
    if anonymize:
        df = df.select(*[c for c in df.columns if c not in ALL_SECTIONS],
                       *[T.anonymize(F.col(n), lang).alias(n) for n in ALL_SECTIONS])
    df = df.withColumn("processed_text", join_sections())
    if not keep_sections:
        df = df.drop(*ALL_SECTIONS)
    return df
