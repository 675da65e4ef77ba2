"""Driver queries for filters, projections and profiles over ``legal``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import filters as FL
from ..operators import profile as PR
from ..operators.preprocess import ALL_SECTIONS, preprocess
from ..session import read_table
from .legal import legal, with_legal
from .registry import query

META_FIELDS = ["court", "date", "case_number", "document_type", "jurisdiction", "year", "source", "language"]


@query("filter_court", with_legal("SELECT doc_id, court FROM legal WHERE starts_with(court, 'BGH') OR starts_with(court, 'BVerfG')"))
def filter_court(spark, sf_dir):
    return FL.filter_courts(legal(spark, sf_dir), ["BGH", "BVerfG"]).select("doc_id", "court")


@query("filter_year", with_legal("SELECT doc_id, date FROM legal WHERE substr(date, 1, 4) IN ('2012', '2013')"))
def filter_year(spark, sf_dir):
    return FL.filter_years(legal(spark, sf_dir), [2012, 2013]).select("doc_id", "date")


@query("filter_doc_type", with_legal("SELECT doc_id, document_type FROM legal WHERE document_type IN ('Urteil', 'Beschluss')"))
def filter_doc_type(spark, sf_dir):
    return FL.filter_doc_types(legal(spark, sf_dir), ["Urteil", "Beschluss"]).select("doc_id", "document_type")


@query("filter_cases", with_legal(
    "SELECT doc_id, jurisdiction, date FROM legal WHERE jurisdiction = 'federal' AND "
    "CAST(try_strptime(date, '%Y%m%d') AS DATE) BETWEEN DATE '2012-03-01' AND DATE '2016-06-30'"))
def filter_cases(spark, sf_dir):
    df = FL.filter_cases(legal(spark, sf_dir), "federal", "2012-03-01", "2016-06-30")
    return df.select("doc_id", "jurisdiction", "date")


@query("filter_authorised", with_legal(
    "SELECT doc_id, source FROM legal WHERE source IN (SELECT DISTINCT source FROM legal WHERE court LIKE 'BGH%')"))
def filter_authorised(spark, sf_dir):
    lg = legal(spark, sf_dir)
    allow = lg.where(F.col("court").startswith("BGH")).select("source")
    return FL.filter_authorised(lg, allow).select("doc_id", "source")


@query("filter_quality", with_legal(
    "SELECT l.doc_id, b.quality, l.language FROM legal l JOIN labels b USING (doc_id) WHERE b.quality >= 1"))
def filter_quality(spark, sf_dir):
    df = FL.filter_quality(legal(spark, sf_dir), read_table(spark, sf_dir, "labels"), 1)
    return df.select("doc_id", "quality", "language")


@query("metadata_completeness", with_legal(
    "SELECT field, CAST(missing AS BIGINT) AS missing, CAST(n - missing AS BIGINT) AS present, "
    "round(1.0 - missing / n, 6) AS completeness FROM (SELECT count(*) AS n, "
    + ", ".join(f"sum(CASE WHEN {f} IS NULL OR CAST({f} AS VARCHAR) = '' THEN 1 ELSE 0 END) AS {f}" for f in META_FIELDS)
    + " FROM legal) UNPIVOT (missing FOR field IN (" + ", ".join(META_FIELDS) + "))"))
def metadata_completeness(spark, sf_dir):
    return PR.completeness(legal(spark, sf_dir), META_FIELDS)


@query("metadata_defaults", with_legal(
    "SELECT doc_id, " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), 'unknown') AS {f}"
                                  for f in ["court", "date", "case_number", "document_type"])
    + ", 'de' AS meta_language, 'rechtsprechung-im-internet' AS meta_source FROM legal"))
def metadata_defaults(spark, sf_dir):
    df = FL.with_metadata_defaults(legal(spark, sf_dir), ["court", "date", "case_number", "document_type"],
                                   {"meta_language": "de", "meta_source": P.SOURCE_DE})
    return df.select("doc_id", "court", "date", "case_number", "document_type", "meta_language", "meta_source")


@query("truncate_12000",
       "SELECT doc_id, CAST(length(t) AS BIGINT) AS truncated_length, md5(t) AS truncated_md5, "
       "t LIKE '%...' AS ends_with_ellipsis FROM (SELECT doc_id, CASE WHEN length(text) > 12000 "
       "THEN concat(substring(text, 1, 12000), '...') ELSE text END AS t FROM documents)")
def truncate_12000(spark, sf_dir):
    t = T.truncate_text(F.col("text"), 12000)
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).cast("bigint").alias("truncated_length"), F.md5(t).alias("truncated_md5"),
        t.endswith("...").alias("ends_with_ellipsis"))


@query("truncate_5000",
       "SELECT doc_id, CAST(length(t) AS BIGINT) AS truncated_length, md5(t) AS truncated_md5 "
       "FROM (SELECT doc_id, CASE WHEN length(text) > 5000 "
       "THEN concat(substring(text, 1, 5000), '...') ELSE text END AS t FROM documents)")
def truncate_5000(spark, sf_dir):
    t = T.truncate_text(F.col("text"), 5000)
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).cast("bigint").alias("truncated_length"), F.md5(t).alias("truncated_md5"))


@query("decision_date", with_legal(
    "SELECT doc_id, date, CAST(try_strptime(date, '%Y%m%d') AS DATE) AS decision_date, "
    "CAST(year(CAST(try_strptime(date, '%Y%m%d') AS DATE)) AS INTEGER) AS decision_year FROM legal"))
def decision_date(spark, sf_dir):
    return FL.with_decision_date(legal(spark, sf_dir)).select("doc_id", "date", "decision_date", "decision_year")


@query("path_key", with_legal("SELECT doc_id, replace(case_number, '/', '_') AS doc_key FROM legal"))
def path_key(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.path_key("case_number").alias("doc_key"))


@query("take_docs", with_legal("SELECT doc_id, court FROM legal ORDER BY doc_id LIMIT 50"))
def take_docs(spark, sf_dir):
    return FL.take_docs(legal(spark, sf_dir), 50, ["doc_id"]).select("doc_id", "court")


# ---------------------------------------------------------------- profiles
from .text_q import _pre_sql  # noqa: E402


@query("doc_stats", _pre_sql(
    "SELECT doc_id, CAST(length(processed_text) AS INTEGER) AS text_length, CAST("
    + " + ".join(f"({c} IS NOT NULL)::INT" for c in ALL_SECTIONS) + " AS INTEGER) AS num_sections FROM p"))
def doc_stats(spark, sf_dir):
    df = preprocess(legal(spark, sf_dir), "text", F.col("language"))
    return FL.with_doc_stats(df, "processed_text", ALL_SECTIONS).select("doc_id", "text_length", "num_sections")


@query("section_counts", _pre_sql(
    "SELECT section, CAST(documents AS BIGINT) AS documents FROM (SELECT "
    + ", ".join(f"count({c}) AS {c}" for c in ALL_SECTIONS) + " FROM s) UNPIVOT (documents FOR section IN ("
    + ", ".join(ALL_SECTIONS) + "))"))
def section_counts(spark, sf_dir):
    df = preprocess(legal(spark, sf_dir), "text", F.col("language"), anonymize=False)
    out = PR.section_counts(df, ALL_SECTIONS)
    return out.select("section", F.col("documents").cast("bigint").alias("documents"))


@query("distribution_doc_type", with_legal(
    "SELECT coalesce(document_type, 'unknown') AS value, CAST(count(*) AS BIGINT) AS count, "
    "round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM legal GROUP BY 1"))
def distribution_doc_type(spark, sf_dir):
    return PR.distribution(legal(spark, sf_dir), "document_type")


@query("length_summary", with_legal(
    "SELECT language, CAST(count(n) AS BIGINT) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, "
    "min(n) AS min, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, "
    "round(quantile_cont(n, 0.75), 6) AS p75, max(n) AS max FROM "
    "(SELECT language, CAST(length(text) AS DOUBLE) AS n FROM legal) GROUP BY language"))
def length_summary(spark, sf_dir):
    df = PR.describe_lengths(legal(spark, sf_dir), F.length("text"), by=["language"])
    return df.select("language", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                     *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("length_histogram",
       "WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM documents WHERE n_chars IS NOT NULL), "
       "m AS (SELECT min(x) AS lo, max(x) AS hi FROM d) "
       "SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS bin_start, round(lo + (bin + 1) * (hi - lo) / 20, 6) AS bin_end, "
       "CAST(count(*) AS BIGINT) AS count FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE "
       "least(floor((x - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin, lo, hi FROM d, m) GROUP BY bin, lo, hi")
def length_histogram(spark, sf_dir):
    h = PR.length_histogram(read_table(spark, sf_dir, "documents"), "n_chars", 20)
    return h.select("bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "count")


@query("catalogue_stats", with_legal(
    "SELECT 'document_type' AS dimension, coalesce(document_type, 'unknown') AS value, CAST(count(*) AS BIGINT) AS count FROM legal GROUP BY 2 "
    "UNION ALL SELECT 'court', coalesce(court, 'unknown'), CAST(count(*) AS BIGINT) FROM legal GROUP BY 2 "
    "UNION ALL SELECT 'decision_year', coalesce(substr(date, 1, 4), 'unknown'), CAST(count(*) AS BIGINT) FROM legal GROUP BY 2"))
def catalogue_stats(spark, sf_dir):
    df = legal(spark, sf_dir).withColumn("decision_year", F.substring("date", 1, 4))
    return PR.catalogue_stats(df, ["document_type", "court", "decision_year"])


@query("adequacy", with_legal(
    "SELECT CAST(sum(c) AS BIGINT) AS examples, CAST(count(*) AS BIGINT) AS groups, "
    "round(max(c) / sum(c), 6) AS max_share, round(min(c) / sum(c), 6) AS min_share, "
    "sum(c) >= 50000 AS meets_minimum, sum(c) >= 200000 AS meets_ideal, "
    "CASE WHEN sum(c) >= 200000 THEN 'ideal' WHEN sum(c) >= 50000 THEN 'adequate' ELSE 'insufficient' END AS verdict "
    "FROM (SELECT coalesce(jurisdiction, 'unknown') AS k, count(*) AS c FROM legal GROUP BY 1)"))
def adequacy(spark, sf_dir):
    return PR.adequacy(legal(spark, sf_dir), "jurisdiction", P.MIN_EXAMPLES, P.IDEAL_EXAMPLES)


@query("vocabulary_topk", _pre_sql(
    "SELECT term, CAST(sum(tf) AS BIGINT) AS term_freq, CAST(count(*) AS BIGINT) AS doc_freq FROM ("
    "SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(nt, '[^\\pL\\pN§.]+')), '\\.+$', '') AS term FROM n) "
    "WHERE length(term) >= 3 GROUP BY term, doc_id) GROUP BY term ORDER BY doc_freq DESC, term_freq DESC, term LIMIT 100"))
def vocabulary_topk(spark, sf_dir):
    df = legal(spark, sf_dir).withColumn("nt", T.normalize("text", F.col("language")))
    out = PR.mine_vocabulary(df, "doc_id", "nt", 100)
    return out.select("term", F.col("term_freq").cast("bigint").alias("term_freq"),
                      F.col("doc_freq").cast("bigint").alias("doc_freq"))


@query("normalize_flags", with_legal(
    "SELECT doc_id, trim(translate(lower(text), 'ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿÇçÑñ', "
    "'AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuYyyCcNn')) AS flagged FROM legal"))
def normalize_flags(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.normalize_flags(F.col("text"), lowercase=True,
                                                                   remove_accents=True).alias("flagged"))


@query("route_by_type",
       "SELECT page_id, lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS file_type, CASE WHEN lower(regexp_extract(url, "
       "'\\.([^./]+)$', 1)) NOT IN ('txt', 'html', 'htm', 'xml') THEN concat('Unsupported file format: ', url) END AS error "
       "FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.html' WHEN 1 THEN url || '.xml' WHEN 2 THEN url || '.TXT' "
       "WHEN 3 THEN url || '.pdf' ELSE url END AS url FROM pages)")
def route_by_type(spark, sf_dir):
    from ..sources.readers import route_by_type as _route
    p = read_table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE page_id % 5 WHEN 0 THEN url || '.html' WHEN 1 THEN url || '.xml' WHEN 2 THEN url || '.TXT' "
        "WHEN 3 THEN url || '.pdf' ELSE url END AS url")
    return _route(p, "url").select("page_id", "file_type", "error")


_CAT = "CASE WHEN quality = 1 THEN upper(coalesce(court, 'unknown')) ELSE court END"


@query("merge_catalogue", with_legal(
    f", cat AS (SELECT case_number AS ck, {_CAT} AS c_court, date AS c_date, 'https://example.invalid/' || doc_id AS c_link "
    "FROM legal JOIN labels USING (doc_id)) "
    "SELECT doc_id, CASE WHEN ck IS NOT NULL THEN c_court ELSE court END AS court, "
    "CASE WHEN ck IS NOT NULL THEN c_date ELSE date END AS date, CASE WHEN ck IS NOT NULL THEN c_link END AS link "
    "FROM (SELECT * FROM legal WHERE language = 'de') d LEFT JOIN (SELECT DISTINCT ON (ck) * FROM cat ORDER BY ck, c_link) c "
    "ON d.case_number = c.ck"))
def merge_catalogue(spark, sf_dir):
    """Catalogue = the labelled documents (court re-spelled where quality is
    1), one entry per case number; it overrides parsed metadata of the German
    documents it matches."""
    lg = legal(spark, sf_dir)
    cat = lg.join(read_table(spark, sf_dir, "labels"), "doc_id").selectExpr(
        "case_number", f"{_CAT} AS court", "date", "concat('https://example.invalid/', CAST(doc_id AS STRING)) AS link")
    # one catalogue entry per case number (smallest link), like a keyed catalogue
    cat = cat.groupBy("case_number").agg(F.min_by(F.struct("court", "date", "link"), F.col("link")).alias("_c")).select(
        "case_number", "_c.*")
    out = FL.merge_catalogue(lg.where(F.col("language") == "de"), cat, "case_number", ["court", "date", "link"])
    return out.select("doc_id", "court", "date", "link")
