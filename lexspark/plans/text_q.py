"""Driver queries for text operators (TXT, SEC, CIT, ANO) over the ``legal`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import citations as C
from ..operators.preprocess import ALL_SECTIONS, preprocess, with_sections
from ..session import read_table
from . import sql_re2 as R
from .legal import legal, with_legal
from .registry import query

# ---------------------------------------------------------------- oracle CTEs
_NORM = f"SELECT *, {R.normalize_sql('text', 'language')} AS nt FROM legal"


def _sections_cte(fallback: bool = True) -> str:
    cols = []
    for name, pat in R.SECTIONS_EN:
        cols.append(f"CASE WHEN language = 'en' THEN {R.first_group_sql('nt', pat)} END AS {name}")
    for name, pat in R.SECTIONS_DE:
        cols.append(f"CASE WHEN language = 'de' THEN {R.first_group_sql('nt', pat)} END AS {name}")
    s = "SELECT *, " + ", ".join(cols) + " FROM n"
    if fallback:
        none = " AND ".join(f"{c} IS NULL" for c in ALL_SECTIONS)
        s = f"SELECT * REPLACE (CASE WHEN {none} THEN nt ELSE body END AS body) FROM s0"
    return s


def _masked_cte() -> str:
    cols = ", ".join(f"{R.anonymize_sql(c, 'language')} AS {c}" for c in ALL_SECTIONS)
    return f"SELECT * REPLACE ({cols}) FROM s"


_PRE = with_legal(f"""
, n AS ({_NORM})
, s0 AS ({_sections_cte(False)})
, s AS ({_sections_cte(True)})
, m AS ({_masked_cte()})
, p AS (SELECT *, {R.citations_sql('nt', 'language')} AS cits,
        concat_ws(chr(10) || chr(10), {', '.join(ALL_SECTIONS)}) AS processed_text FROM m)
""")


def _pre_sql(select: str) -> str:
    return _PRE + select


def _pre(spark, sf_dir, **kw):
    return preprocess(legal(spark, sf_dir), "text", F.col("language"), **kw)


# ---------------------------------------------------------------- normalise

@query("normalize_en", with_legal(f"SELECT doc_id, {R.normalize_sql('text', chr(39) + 'en' + chr(39))} AS normalized FROM legal"))
def normalize_en(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.normalize("text", "en").alias("normalized"))


@query("normalize_de", with_legal(f"SELECT doc_id, {R.normalize_sql('text', chr(39) + 'de' + chr(39))} AS normalized FROM legal"))
def normalize_de(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.normalize("text", "de").alias("normalized"))


@query("normalize_other", f"SELECT doc_id, lang, {R.normalize_sql('text', 'lang')} AS normalized FROM documents WHERE lang IN ('fr', 'es')")
def normalize_other(spark, sf_dir):
    """Languages with no rule of their own: white space collapsed, ends trimmed."""
    df = read_table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "es"))
    return df.select("doc_id", "lang", T.normalize("text", F.col("lang")).alias("normalized"))


@query("clean_german", with_legal(f"SELECT doc_id, {R.clean_german_sql('text')} AS cleaned FROM legal WHERE language = 'de'"))
def clean_german(spark, sf_dir):
    df = legal(spark, sf_dir).where(F.col("language") == "de")
    return df.select("doc_id", T.clean_german("text").alias("cleaned"))


# ---------------------------------------------------------------- sections

@query("sections_en", _pre_sql("SELECT doc_id, header, body, conclusion FROM s0 WHERE language = 'en'"))
def sections_en(spark, sf_dir):
    df = legal(spark, sf_dir).where(F.col("language") == "en")
    df = df.withColumn("nt", T.normalize("text", "en"))
    return with_sections(df, "nt", "en", fallback=False).select("doc_id", "header", "body", "conclusion")


@query("sections_de", _pre_sql("SELECT doc_id, tatbestand, gruende, tenor, leitsaetze FROM s0 WHERE language = 'de'"))
def sections_de(spark, sf_dir):
    df = legal(spark, sf_dir).where(F.col("language") == "de")
    df = df.withColumn("nt", T.normalize("text", "de"))
    return with_sections(df, "nt", "de", fallback=False).select(
        "doc_id", "tatbestand", "gruende", "tenor", "leitsaetze")


@query("sections_fallback", _pre_sql(
    "SELECT doc_id, language, body, CAST(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in ALL_SECTIONS)
    + " AS BIGINT) AS n_sections FROM s"))
def sections_fallback(spark, sf_dir):
    df = legal(spark, sf_dir).withColumn("nt", T.normalize("text", F.col("language")))
    df = with_sections(df, "nt", F.col("language"), fallback=True)
    n = sum(F.col(c).isNotNull().cast("int") for c in ALL_SECTIONS)
    return df.select("doc_id", "language", "body", n.cast("bigint").alias("n_sections"))


@query("processed_text", _pre_sql("SELECT doc_id, language, processed_text FROM p"))
def processed_text(spark, sf_dir):
    return _pre(spark, sf_dir).select("doc_id", "language", "processed_text")


# ---------------------------------------------------------------- citations

@query("citations_en", _pre_sql(
    "SELECT doc_id, CAST(len(cits) AS BIGINT) AS n_citations, array_to_string(cits, ' | ') AS citations "
    "FROM p WHERE language = 'en'"))
def citations_en(spark, sf_dir):
    df = legal(spark, sf_dir).where(F.col("language") == "en")
    c = T.citations(T.normalize("text", "en"), "en")
    return df.select("doc_id", F.size(c).cast("bigint").alias("n_citations"),
                     F.array_join(c, " | ").alias("citations"))


@query("citations_de", _pre_sql(
    "SELECT doc_id, CAST(len(cits) AS BIGINT) AS n_citations, array_to_string(cits, ' | ') AS citations "
    "FROM p WHERE language = 'de'"))
def citations_de(spark, sf_dir):
    df = legal(spark, sf_dir).where(F.col("language") == "de")
    c = T.citations(T.normalize("text", "de"), "de")
    return df.select("doc_id", F.size(c).cast("bigint").alias("n_citations"),
                     F.array_join(c, " | ").alias("citations"))


@query("citation_table", _pre_sql(
    "SELECT doc_id, CAST(pos AS BIGINT) AS ordinal, citation FROM "
    "(SELECT doc_id, unnest(generate_series(0, len(cits) - 1)) AS pos, unnest(cits) AS citation FROM p)"))
def citation_table(spark, sf_dir):
    return C.citation_table(_pre(spark, sf_dir, keep_sections=False), "doc_id", "citations")


@query("citation_standard", _pre_sql(
    "SELECT doc_id, CAST(pos AS BIGINT) AS ordinal, "
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(citation, '\\s+', ' ', 'g'), "
    "'\\bAbsatz\\b', 'Abs.', 'g'), '\\bSatz\\b', 'S.', 'g'), '§ ?', '§ ', 'g'), 'Art\\. ?', 'Art. ', 'g')) AS citation "
    "FROM (SELECT doc_id, unnest(generate_series(0, len(cits) - 1)) AS pos, unnest(cits) AS citation FROM p "
    "WHERE language = 'de')"))
def citation_standard(spark, sf_dir):
    df = _pre(spark, sf_dir, keep_sections=False).where(F.col("language") == "de")
    t = C.citation_table(df, "doc_id", "citations")
    return t.select("doc_id", "ordinal", T.standardize_citation("citation").alias("citation"))


@query("citation_edges", _pre_sql(
    "SELECT doc_id, citation AS authority, CAST(count(*) AS BIGINT) AS weight FROM "
    "(SELECT doc_id, unnest(cits) AS citation FROM p) GROUP BY doc_id, citation"))
def citation_edges(spark, sf_dir):
    return C.citation_edges(_pre(spark, sf_dir, keep_sections=False), "doc_id", "citations")


@query("top_authorities", _pre_sql(
    "SELECT authority, in_degree, citations FROM (SELECT citation AS authority, "
    "CAST(count(DISTINCT doc_id) AS BIGINT) AS in_degree, CAST(count(*) AS BIGINT) AS citations "
    "FROM (SELECT doc_id, unnest(cits) AS citation FROM p) GROUP BY citation) "
    "ORDER BY in_degree DESC, citations DESC, authority LIMIT 20"))
def top_authorities(spark, sf_dir):
    return C.top_authorities(_pre(spark, sf_dir, keep_sections=False), "doc_id", "citations", k=20)


@query("co_citations", _pre_sql(
    "SELECT e.doc_id, CAST(count(*) AS BIGINT) AS n_authorities, "
    "CAST(sum(a.in_degree - 1) AS BIGINT) AS shared_incidences, "
    "CAST(max(a.in_degree - 1) AS BIGINT) AS max_partners "
    "FROM (SELECT DISTINCT doc_id, citation FROM (SELECT doc_id, unnest(cits) AS citation FROM p)) e "
    "JOIN (SELECT citation, count(DISTINCT doc_id) AS in_degree FROM "
    "(SELECT doc_id, unnest(cits) AS citation FROM p) GROUP BY citation) a USING (citation) "
    "GROUP BY e.doc_id"))
def co_citations(spark, sf_dir):
    return C.co_citation_profile(_pre(spark, sf_dir, keep_sections=False), "doc_id", "citations")


@query("nearest_by_authorities", _pre_sql(
    ", ne AS (SELECT DISTINCT doc_id, citation FROM (SELECT doc_id, unnest(cits) AS citation FROM p)), "
    "nw AS (SELECT citation, CAST(floor(1000 * ln(CAST((SELECT count(DISTINCT doc_id) FROM ne) + 1 AS DOUBLE) / count(*))) AS BIGINT) AS w FROM ne GROUP BY citation), "
    "ns AS (SELECT a.doc_id, b.doc_id AS partner, CAST(sum(w) AS BIGINT) AS score FROM ne a JOIN ne b ON a.citation = b.citation AND a.doc_id <> b.doc_id JOIN nw ON nw.citation = a.citation GROUP BY 1, 2) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, partner) AS INTEGER) AS rank, partner, score FROM ns WHERE score > 0 QUALIFY rank <= 3").replace(" , ne AS", ", ne AS"))
def nearest_by_authorities(spark, sf_dir):
    """The three nearest documents of each by shared authorities."""
    from ..operators.neighbours import nearest_by_authorities as nearest
    return nearest(_pre(spark, sf_dir, keep_sections=False), 3, "doc_id", "citations", most=100)


# ---------------------------------------------------------------- masking

@query("anonymize_en", with_legal(
    f"SELECT doc_id, {R.anonymize_sql(R.normalize_sql('text', chr(39) + 'en' + chr(39)), chr(39) + 'en' + chr(39))} AS masked "
    "FROM legal WHERE language = 'en'"))
def anonymize_en(spark, sf_dir):
    df = legal(spark, sf_dir).where(F.col("language") == "en")
    return df.select("doc_id", T.anonymize(T.normalize("text", "en"), "en").alias("masked"))


@query("anonymize_de", with_legal(
    f"SELECT doc_id, {R.anonymize_sql(R.normalize_sql('text', chr(39) + 'de' + chr(39)), chr(39) + 'de' + chr(39))} AS masked "
    "FROM legal WHERE language = 'de'"))
def anonymize_de(spark, sf_dir):
    df = legal(spark, sf_dir).where(F.col("language") == "de")
    return df.select("doc_id", T.anonymize(T.normalize("text", "de"), "de").alias("masked"))


def _pii_sql() -> str:
    names = []
    for n, _, _ in P.ANON_EN + P.ANON_DE:
        if n not in names:
            names.append(n)
    en = {n: p for n, p, _ in P.ANON_EN}
    de = {n: p for n, p, _ in P.ANON_DE}
    cols = []
    for n in names:
        e = f"len(regexp_extract_all(nt, {R.q(en[n])}, 0))" if n in en else "0"
        d = f"len(regexp_extract_all(nt, {R.q(de[n])}, 0))" if n in de else "0"
        cols.append(f"CAST(sum(CASE WHEN language = 'en' THEN {e} WHEN language = 'de' THEN {d} ELSE 0 END) AS BIGINT) AS {n}")
    return _pre_sql("SELECT source, language, CAST(count(*) AS BIGINT) AS n_docs, " + ", ".join(cols)
                    + " FROM n GROUP BY source, language")


@query("pii_report", _pii_sql())
def pii_report(spark, sf_dir):
    from ..operators.profile import pii_report as _pii
    df = legal(spark, sf_dir).withColumn("nt", T.normalize("text", F.col("language")))
    return _pii(df, "nt", F.col("language"), by=["source", "language"])


@query("preprocess", _pre_sql(
    "SELECT doc_id, language, processed_text, CAST(len(cits) AS BIGINT) AS n_citations, "
    "array_to_string(cits, ' | ') AS citations, "
    + ", ".join(f"({c} IS NOT NULL) AS has_{c}" for c in ALL_SECTIONS) + " FROM p"))
def preprocess_q(spark, sf_dir):
    df = _pre(spark, sf_dir)
    return df.select("doc_id", "language", "processed_text",
                     F.size("citations").cast("bigint").alias("n_citations"),
                     F.array_join("citations", " | ").alias("citations"),
                     *[F.col(c).isNotNull().alias(f"has_{c}") for c in ALL_SECTIONS])


@query("legal_profile", _pre_sql(
    "SELECT language, CAST(count(*) AS BIGINT) AS documents, "
    + ", ".join(f"CAST(count({c}) AS BIGINT) AS with_{c}" for c in ALL_SECTIONS)
    + ", CAST(sum(len(cits)) AS BIGINT) AS citations, CAST(sum(length(processed_text)) AS BIGINT) AS processed_chars "
    "FROM p GROUP BY language"))
def legal_profile(spark, sf_dir):
    """The flagship (``entry``): preprocessing profile per language."""
    from .flagship import flagship
    return flagship(spark, sf_dir)
