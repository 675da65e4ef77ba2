"""Driver queries for splits, sampling, batching, manifests and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.arrays import explode_rows
from ..operators import augment as AU
from ..operators import profile as PR
from ..operators import splits as SP
from ..session import kept, read_table
from . import sql_re2 as R
from .instruct_q import _sql_examples_en, examples_en
from .legal import legal, with_legal
from .registry import query

q = R.q


def _h(*cols: str) -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


def _u(h: str) -> str:
    return f"(('0x' || substr({h}, 1, 8))::BIGINT / 4294967296.0)"


def _ex_en(spark, sf_dir):
    return examples_en(spark, sf_dir).select("id", "metadata.document_type", "metadata.year", "metadata.task")


_SPLIT3 = ("CASE WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' "
           "WHEN rn <= floor(0.8::DOUBLE * n) + floor((n - floor(0.8::DOUBLE * n)) * 0.5::DOUBLE) THEN 'validation' "
           "ELSE 'test' END")


@query("split_random", _sql_examples_en() + f"SELECT id, {_SPLIT3} AS split FROM (SELECT id, "
       f"row_number() OVER (ORDER BY {_h('id')}, id) AS rn, count(*) OVER () AS n FROM ex)")
def split_random(spark, sf_dir):
    return SP.split_dataset(_ex_en(spark, sf_dir), "id").select("id", "split")


@query("split_hash", _sql_examples_en() + f"SELECT id, CASE WHEN {_u(_h('id'))} < 0.8 THEN 'train' "
       f"WHEN {_u(_h('id'))} < (0.8::DOUBLE + 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ex")
def split_hash(spark, sf_dir):
    return SP.hash_split(_ex_en(spark, sf_dir), "id").select("id", "split")


@query("split_stratified", _sql_examples_en() + f"SELECT id, document_type, {_SPLIT3} AS split FROM (SELECT id, "
       f"document_type, row_number() OVER (PARTITION BY document_type ORDER BY {_h('id')}, id) AS rn, "
       "count(*) OVER (PARTITION BY document_type) AS n FROM ex)")
def split_stratified(spark, sf_dir):
    return SP.split_dataset(_ex_en(spark, sf_dir), "id", stratify_by="document_type").select(
        "id", "document_type", "split")


@query("split_temporal", _sql_examples_en() + "SELECT id, year, CASE WHEN coalesce(year, 0) < 2020 THEN 'train' "
       "WHEN coalesce(year, 0) = 2020 THEN 'validation' ELSE 'test' END AS split FROM ex")
def split_temporal(spark, sf_dir):
    return SP.temporal_split(_ex_en(spark, sf_dir), "year", 2020).select("id", "year", "split")


@query("split_two_way", _sql_examples_en() + f"SELECT id, CASE WHEN rn <= floor(0.9::DOUBLE * n) THEN 'train' "
       f"ELSE 'validation' END AS split FROM (SELECT id, row_number() OVER (ORDER BY {_h('id')}, id) AS rn, "
       "count(*) OVER () AS n FROM ex)")
def split_two_way(spark, sf_dir):
    return SP.split_two_way(_ex_en(spark, sf_dir), "id", 0.9).select("id", "split")


@query("shuffle_order", _sql_examples_en() + f"SELECT id, CAST(row_number() OVER (ORDER BY {_h('id')}, id) - 1 AS BIGINT) AS rank FROM ex")
def shuffle_order(spark, sf_dir):
    return SP.global_rank(_ex_en(spark, sf_dir), "id").select("id", "rank")


@query("split_counts", _sql_examples_en() + f"SELECT split, CAST(count(*) AS BIGINT) AS count FROM (SELECT id, {_SPLIT3} AS split FROM "
       f"(SELECT id, document_type, row_number() OVER (PARTITION BY document_type ORDER BY {_h('id')}, id) AS rn, "
       "count(*) OVER (PARTITION BY document_type) AS n FROM ex)) GROUP BY split")
def split_counts(spark, sf_dir):
    s = SP.split_dataset(_ex_en(spark, sf_dir), "id", stratify_by="document_type")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("count"))


_STRAT = (f"(SELECT id, document_type, {_SPLIT3} AS split FROM (SELECT id, document_type, row_number() OVER "
          f"(PARTITION BY document_type ORDER BY {_h('id')}, id) AS rn, count(*) OVER (PARTITION BY document_type) AS n FROM ex))")


@query("distribution_by_split", _sql_examples_en() +
       f"SELECT split, coalesce(document_type, 'unknown') AS value, CAST(count(*) AS BIGINT) AS count, "
       f"round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 1) AS percent FROM {_STRAT} GROUP BY 1, 2")
def distribution_by_split(spark, sf_dir):
    s = SP.split_dataset(_ex_en(spark, sf_dir), "id", stratify_by="document_type")
    return PR.distribution(s, "document_type", by=["split"])


@query("split_manifest", _sql_examples_en() +
       "SELECT split, CAST(sum(c) AS BIGINT) AS count, string_agg(concat(value, ':', CAST(c AS VARCHAR)), ',' ORDER BY value) "
       "AS distribution, 'id,conversations,metadata' AS fields FROM (SELECT split, coalesce(document_type, 'unknown') AS value, "
       f"count(*) AS c FROM {_STRAT} GROUP BY 1, 2) GROUP BY split")
def split_manifest(spark, sf_dir):
    ex = examples_en(spark, sf_dir)
    s = SP.split_dataset(ex.withColumn("document_type", F.col("metadata.document_type")), "id",
                         stratify_by="document_type")
    m = PR.manifest(s.drop("document_type", "doc_id"), "split", "metadata.document_type")
    return m.select("split", "count", "distribution", F.array_join("fields", ",").alias("fields"))


_MIX = {"BGH 2. Strafsenat": 0.25, "BGH 9. Zivilsenat": 0.30, "BVerfG 1. Senat": 0.20, "OLG Köln": 0.15,
        "unknown": 0.10}
_MIX_CASE = "CASE cat " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in _MIX.items()) + " END"


@query("mix_shares", with_legal(
    f", c AS (SELECT doc_id, coalesce(court, 'unknown') AS cat FROM legal), "
    f"k AS (SELECT cat, count(*) AS n FROM c GROUP BY cat), "
    f"cap AS (SELECT min(floor(n / {_MIX_CASE})) AS big_n FROM k) "
    f"SELECT doc_id, cat AS category FROM (SELECT doc_id, cat, row_number() OVER (PARTITION BY cat ORDER BY "
    f"{_h('doc_id')}, doc_id) AS rn, floor(big_n * {_MIX_CASE}) AS quota FROM c, cap) WHERE rn <= quota"))
def mix_shares(spark, sf_dir):
    df = legal(spark, sf_dir).select("doc_id", F.coalesce("court", F.lit("unknown")).alias("category"))
    return SP.mix(df, "doc_id", "category", _MIX)


@query("assign_variant", with_legal(
    f"SELECT doc_id, CASE WHEN {_u(_h('doc_id'))} < 0.7 THEN 'ModelA' ELSE 'ModelB' END AS variant FROM legal"))
def assign_variant(spark, sf_dir):
    return SP.assign_variant(legal(spark, sf_dir), "doc_id", {"ModelA": 0.7, "ModelB": 0.3}).select(
        "doc_id", "variant")


@query("capture_sample", f"SELECT event_id, event_type FROM events WHERE {_u(_h('event_id'))} < 1.0")
def capture_sample(spark, sf_dir):
    return SP.capture_sample(read_table(spark, sf_dir, "events"), "event_id", 100).select("event_id", "event_type")


@query("capture_sample_25", f"SELECT event_id, event_type FROM events WHERE {_u(_h('event_id'))} < 0.25")
def capture_sample_25(spark, sf_dir):
    return SP.capture_sample(read_table(spark, sf_dir, "events"), "event_id", 25).select("event_id", "event_type")


@query("length_buckets",
       "SELECT doc_id, n_chars, CAST(floor(n_chars / 256) AS BIGINT) AS length_bucket, "
       f"CAST(('0x' || substr({_h('doc_id')}, 1, 8))::BIGINT % 64 AS INTEGER) AS salt, "
       "CAST(floor((row_number() OVER (PARTITION BY floor(n_chars / 256), ('0x' || substr(" + _h('doc_id') + ", 1, 8))::BIGINT % 64 "
       "ORDER BY n_chars, doc_id) - 1) / 8) AS BIGINT) AS batch_no FROM documents")
def length_buckets(spark, sf_dir):
    d = SP.bucket_by_length(read_table(spark, sf_dir, "documents"), "n_chars", "doc_id", 8)
    return d.select("doc_id", "n_chars", "length_bucket", "salt", "batch_no")


@query("token_budget_batches",
       f"WITH RECURSIVE r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, {_h('doc_id')}, doc_id) AS rn FROM documents), "
       "s AS (SELECT CAST(0 AS BIGINT) AS batch_id, CAST(1 AS BIGINT) AS a, (SELECT greatest(1, 65536 // greatest(1, n_chars)) FROM r WHERE rn = 1) AS m UNION ALL "
       "SELECT s.batch_id + 1, r.rn, greatest(1, 65536 // greatest(1, r.n_chars)) FROM s JOIN r ON r.rn = s.a + s.m) "
       "SELECT doc_id, n_chars, batch_id FROM r JOIN s ON rn >= a AND rn < a + m")
def token_budget_batches(spark, sf_dir):
    """Documents in batches of at most 65,536 padded characters."""
    return SP.batch_by_budget(read_table(spark, sf_dir, "documents"), "n_chars", "doc_id", 65536).select("doc_id", "n_chars", "batch_id")


@query("batch_ids", f"SELECT conv_id, turn, CAST(floor((row_number() OVER (ORDER BY {_h('conv_id', 'turn')}, conv_id, turn) - 1) / 100) AS BIGINT) "
       "AS batch_id FROM conversations")
def batch_ids(spark, sf_dir):
    d = SP.with_batch_id(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], 100)
    return d.select("conv_id", "turn", "batch_id")


# ---------------------------------------------------------------- augmentation

_EN_DOCS = f"SELECT doc_id, jurisdiction, year, {R.normalize_sql('text', chr(39) + 'en' + chr(39))} AS nt FROM legal WHERE language = 'en'"


def _en_docs(spark, sf_dir):
    return legal(spark, sf_dir).where(F.col("language") == "en").select(
        "doc_id", "jurisdiction", "year", T.normalize("text", "en").alias("nt"))


def _aug_sql() -> str:
    jv = " UNION ALL ".join(
        f"SELECT doc_id, 'jurisdiction:{j}' AS variant, replace(nt, 'jurisdiction of ' || jurisdiction, "
        f"'jurisdiction of {j}') AS nt, '{j}' AS jurisdiction, year FROM d WHERE jurisdiction IS NOT NULL AND jurisdiction <> '{j}'"
        for j in P.JURISDICTIONS)
    yv = " UNION ALL ".join(
        f"SELECT doc_id, 'year:' || CAST(year + ({s}) AS VARCHAR) AS variant, replace(nt, 'in ' || CAST(year AS VARCHAR), "
        f"'in ' || CAST(year + ({s}) AS VARCHAR)) AS nt, jurisdiction, CAST(year + ({s}) AS INTEGER) AS year FROM d "
        f"WHERE year IS NOT NULL AND year + ({s}) > 1900 AND year + ({s}) < 2023" for s in P.YEAR_SHIFTS)
    return with_legal(
        f", d AS ({_EN_DOCS}) SELECT doc_id, variant, jurisdiction, year, md5(nt) AS text_md5, "
        f"CAST(length(nt) AS INTEGER) AS text_length FROM (SELECT doc_id, 'original' AS variant, nt, jurisdiction, year "
        f"FROM d UNION ALL {jv} UNION ALL {yv})")


@query("augment_cases", _aug_sql())
def augment_cases(spark, sf_dir):
    a = AU.augment_cases(_en_docs(spark, sf_dir), "nt")
    return a.select("doc_id", "variant", "jurisdiction", "year", F.md5("nt").alias("text_md5"),
                    F.length("nt").alias("text_length"))


def _aug_filtered(cond: str) -> str:
    return (_aug_sql().replace("SELECT doc_id, variant, jurisdiction, year, md5(nt)",
                               "SELECT * FROM (SELECT doc_id, variant, jurisdiction, year, md5(nt)")
            + f") WHERE {cond}")


@query("augment_jurisdiction", _aug_filtered("variant = 'original' OR variant LIKE 'jurisdiction:%'"))
def augment_jurisdiction(spark, sf_dir):
    a = AU.augment_cases(_en_docs(spark, sf_dir), "nt", year=False)
    return a.select("doc_id", "variant", "jurisdiction", "year", F.md5("nt").alias("text_md5"),
                    F.length("nt").alias("text_length"))


@query("augment_year", _aug_filtered("variant = 'original' OR variant LIKE 'year:%'"))
def augment_year(spark, sf_dir):
    a = AU.augment_cases(_en_docs(spark, sf_dir), "nt", jurisdiction=False)
    return a.select("doc_id", "variant", "jurisdiction", "year", F.md5("nt").alias("text_md5"),
                    F.length("nt").alias("text_length"))


def _synonyms(docs):
    """Synonym table derived from the corpus: every word of ≥ 4 chars maps to
    its upper-case and its reversed spelling."""
    w = explode_rows(docs, F.split(F.col("nt"), " "), "word").where(F.length("word") >= 4).distinct()
    return w.select("word", F.explode(F.array(F.upper("word"), F.reverse("word"))).alias("synonym"))


def _syn_sql() -> str:
    h = _h("doc_id", "pos")
    hp = "md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), CAST(pos AS VARCHAR), 'p'))"
    hs = "md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), CAST(pos AS VARCHAR), 's'))"
    return with_legal(
        f", d AS ({_EN_DOCS}), "
        "t AS (SELECT doc_id, CASE WHEN trim(nt) = '' THEN []::VARCHAR[] ELSE string_split_regex(trim(nt), ' +') END AS w FROM d), "
        "tok AS (SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word FROM t), "
        "syn AS (SELECT word, list_sort(list_distinct(list(synonym))) AS s FROM (SELECT word, unnest([upper(word), reverse(word)]) AS synonym "
        "FROM (SELECT DISTINCT word FROM (SELECT unnest(string_split(nt, ' ')) AS word FROM d) WHERE length(word) >= 4)) GROUP BY word), "
        f"ch AS (SELECT doc_id, pos, word FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {h}) AS r FROM tok) "
        f"WHERE r <= 5 AND length(word) >= 4 AND {_u(hp)} <= 0.3), "
        f"rep AS (SELECT ch.doc_id, ch.pos, syn.s[(('0x' || substr({hs.replace('doc_id', 'ch.doc_id').replace('pos', 'ch.pos')}, 1, 8))::BIGINT % len(syn.s)) + 1] AS r "
        "FROM ch JOIN syn ON ch.word = syn.word) "
        "SELECT d.doc_id, coalesce(x.text, '') AS text FROM d LEFT JOIN (SELECT tok.doc_id, string_agg(coalesce(rep.r, tok.word), ' ' ORDER BY tok.pos) AS text "
        "FROM tok LEFT JOIN rep ON tok.doc_id = rep.doc_id AND tok.pos = rep.pos GROUP BY tok.doc_id) x ON d.doc_id = x.doc_id")


@query("augment_synonyms", _syn_sql())
def augment_synonyms(spark, sf_dir):
    docs = kept(_en_docs(spark, sf_dir), "en_docs")  # the synonyms are made of them, too
    out = AU.augment_synonyms(docs, _synonyms(docs), "doc_id", "nt")
    return out.select("doc_id", F.col("nt").alias("text"))


@query("manifest_files", _sql_examples_en() +
       "SELECT split, CAST(sum(c) AS BIGINT) AS count, string_agg(concat(value, ':', CAST(c AS VARCHAR)), ',' ORDER BY value) "
       "AS distribution, 'id,conversations,metadata' AS fields FROM (SELECT split, coalesce(document_type, 'unknown') AS value, "
       f"count(*) AS c FROM {_STRAT} GROUP BY 1, 2) GROUP BY split")
def manifest_files(spark, sf_dir):
    """SNK-05: the split manifest written as one JSON object per split
    folder and read back."""

    from ..session import scratch_folder
    from ..sources import sinks as SK
    path = scratch_folder(spark, "manifest")
    SK.write_manifest(split_manifest(spark, sf_dir), path)
    back = spark.read.schema("count long, distribution string, fields string").json(path)
    return back.select("split", "count", "distribution", "fields")
