"""Readers (SRC-01, 04..10, 13, 14). Built-in Spark sources with explicit
schemas; Python only where a format needs it (ZIP members, markup)."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..session import scratch_folder, small_batches
from . import markup

SUPPORTED = ["txt", "html", "htm", "xml"]

MESSAGE = TY.StructType([TY.StructField("role", TY.StringType()), TY.StructField("content", TY.StringType())])
EXAMPLE_METADATA = TY.StructType([TY.StructField(n, t) for n, t in [
    ("document_type", TY.StringType()), ("jurisdiction", TY.StringType()), ("year", TY.IntegerType()),
    ("source", TY.StringType()), ("task", TY.StringType()), ("court", TY.StringType()),
    ("date", TY.StringType()), ("case_number", TY.StringType()), ("language", TY.StringType())]])
EXAMPLE_SCHEMA = TY.StructType([TY.StructField("id", TY.StringType()),
                                TY.StructField("conversations", TY.ArrayType(MESSAGE)),
                                TY.StructField("metadata", EXAMPLE_METADATA)])
DECISION_METADATA = TY.StructType([TY.StructField(n, TY.StringType()) for n in [
    "court", "date", "case_number", "document_type", "procedure_type", "ecli", "link"]])
SECTIONS_DE = TY.StructType([TY.StructField(n, TY.StringType()) for n in
                             ["tatbestand", "gruende", "tenor", "leitsaetze"]])
DECISION_SCHEMA = TY.StructType([TY.StructField("metadata", DECISION_METADATA),
                                 TY.StructField("full_text", TY.StringType()),
                                 TY.StructField("sections", SECTIONS_DE),
                                 TY.StructField("source_file", TY.StringType())])


def read_text_docs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-01: one row per whole UTF-8 text file: (source_file, file_type, raw)."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))
    return df.withColumn("file_type", F.regexp_extract("source_file", r"\.([^./]+)$", 1))


def text_rows(files: DataFrame) -> DataFrame:
    """SRC-01 for rows (path, content as bytes) of any table."""
    return files.select(F.col("path").alias("source_file"), F.col("content").cast("string").alias("raw"),
                        F.regexp_extract("path", r"\.([^./]+)$", 1).alias("file_type"))


def route_by_type(df: DataFrame, path_col: str = "source_file") -> DataFrame:
    """SRC-04: extension routing; unsupported → ``error`` set (reject frame)."""
    ext = F.lower(F.regexp_extract(F.col(path_col), r"\.([^./]+)$", 1))
    return (df.withColumn("file_type", ext)
            .withColumn("error", F.when(~ext.isin(SUPPORTED),
                                        F.concat(F.lit("Unsupported file format: "), F.col(path_col)))))


def decode_documents(df: DataFrame, raw_col: str = "raw", type_col: str = "file_type") -> DataFrame:
    """Text per file type: txt as is, html/htm and xml through one markup UDF
    (text files and rejected rows reach it as NULL). Adds ``text`` and
    ``error`` (existing errors are kept, and their rows have no text)."""
    t = F.col(type_col)
    known = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    markup_rows = t.isin("html", "htm", "xml") & known.isNull()
    safe = F.when(markup_rows, F.make_valid_utf8(F.col(raw_col)))  # Arrow needs valid UTF-8
    d = df.withColumn("_m", markup.markup_to_text(safe, t != "xml"))
    err = F.coalesce(known, F.col("_m.error"))
    return d.withColumn("text", F.when(err.isNull(), F.when(t == "txt", F.col(raw_col)).otherwise(F.col("_m.value")))).withColumn("error", err).drop("_m")


def process_directory(spark: SparkSession, path: str, language: str = "en",
                      anonymize: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC-05: one directory level, four extensions; ``process_files`` on its files."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,html,htm,xml}")
           .option("recursiveFileLookup", "false").load(path)
           .select(F.col("path").alias("source_file"), "content"))
    return process_files(raw, language, anonymize)


def tagged_files(files: DataFrame, language: str = "en", anonymize: bool = True) -> DataFrame:
    """Rows (source_file, content as bytes) routed, decoded and preprocessed in one pass: unsupported
    types, invalid UTF-8 and broken markup have ``error`` and ``rejected`` set and nothing else."""
    from ..operators.preprocess import preprocess

    s = files.select("source_file", F.col("content").cast("string").alias("raw"))
    s = route_by_type(s).withColumn("error", F.coalesce(F.col("error"), F.when(
        ~F.is_valid_utf8(F.col("raw")), F.lit("invalid UTF-8"))))
    out = preprocess(decode_documents(s).drop("raw"), "text", language, anonymize=anonymize)
    return out.withColumn("metadata", F.struct(F.col("source_file"), F.col("file_type"), F.lit(language).alias("language"))).withColumn(
        "rejected", F.col("error").isNotNull())


def process_files(files: DataFrame, language: str = "en", anonymize: bool = True, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``tagged_files`` written once, split by ``rejected``, and read back as
    (processed, rejects). ``path``: where the table stays (default: a scratch
    folder of the session)."""
    spark = files.sparkSession
    path = path or scratch_folder(spark, "files")
    tagged = tagged_files(files, language, anonymize)
    tagged.write.partitionBy("rejected").parquet(path)
    rows = spark.read.schema(tagged.schema).parquet(path)
    return rows.where(~F.col("rejected")).drop("rejected", "error"), rows.where("rejected").select("source_file", "file_type", "error")


def read_examples(spark: SparkSession, path: str, schema: TY.StructType = EXAMPLE_SCHEMA
                  ) -> tuple[DataFrame, DataFrame]:
    """SRC-06: JSONL examples from a file or a folder of .jsonl/.json.
    Lines that are not a JSON object (broken JSON, ``[1]``) are split off
    (returned second, with their file) instead of failing; blank lines vanish."""
    r = spark.read
    if not path.endswith((".jsonl", ".json")):
        r = r.option("pathGlobFilter", "*.{jsonl,json}")
    lines = r.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_source"))
    lines = lines.where(F.trim("line") != "")
    is_object = F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{")
    lines = lines.withColumn("_ok", is_object)
    good = lines.where("_ok").select(F.from_json("line", schema).alias("_e")).select("_e.*")
    bad = lines.where(~F.col("_ok")).select("_source", F.col("line").alias("_corrupt_record"))
    return good, bad


def with_line_numbers(df: DataFrame, out_col: str = "line_no", limit: int | None = None) -> DataFrame:
    """0-based position of every row in input order (file path, split start,
    position in the split) without a global sort: rows are counted per split
    (one small row per split), split offsets come from a window over that
    table, and each row adds its position inside the split. The order key
    must come straight from a file scan (``_metadata`` + scan order).

    ``limit``: keep only rows with position < limit. Splits starting at or
    after the limit are dropped from the offsets table first, so the
    broadcast side holds at most ``limit`` rows and the big side is never
    shuffled (rows of dropped splits fall out in the broadcast join)."""
    d = df.withColumn("_f", F.col("_metadata.file_path")).withColumn(
        "_b", F.col("_metadata.file_block_start")).withColumn("_mid", F.monotonically_increasing_id())
    splits = d.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_mid0"))
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if limit is not None:
        splits = splits.where(F.col("_off") < limit)
    j = d.join(F.broadcast(splits.select("_f", "_b", "_off", "_mid0")), ["_f", "_b"])
    j = j.withColumn(out_col, (F.col("_off") + F.col("_mid") - F.col("_mid0")).cast("bigint"))
    if limit is not None:
        j = j.where(F.col(out_col) < limit)
    return j.drop("_f", "_b", "_mid", "_off", "_mid0")


def load_examples(spark: SparkSession, path: str, max_samples: int | None = None, task: str | None = None,
                  language: str | None = None, schema: TY.StructType = EXAMPLE_SCHEMA) -> DataFrame:
    """SRC-07: strict JSONL; ``max_samples`` bounds input *lines* before the
    task/language filters run (line numbers in file order, no global sort)."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), "_metadata")
    if max_samples is not None:
        lines = with_line_numbers(lines, limit=max_samples)
    parsed = lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("_e")).select("_e.*")
    if task is not None:
        parsed = parsed.where(F.col("metadata.task") == task)
    if language is not None:
        parsed = parsed.where(F.col("metadata.language") == language)
    return parsed


def read_processed_docs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: folder of pretty-printed one-document JSON files."""
    return (spark.read.schema(DECISION_SCHEMA).option("multiLine", True)
            .option("pathGlobFilter", "*.json").json(path))


def processed_rows(files: DataFrame) -> DataFrame:
    """SRC-08 for rows (path, content as bytes): one document each, in the columns of ``read_processed_docs``."""
    return files.select(F.from_json(F.col("content").cast("string"), DECISION_SCHEMA).alias("_d")).select("_d.*")


CATALOGUE_SCHEMA = TY.StructType([TY.StructField(n, TY.StringType()) for n in
                                  ["gericht", "entsch-datum", "aktenzeichen", "link"]])


def read_catalogue(spark: SparkSession, path: str, max_items: int | None = None) -> DataFrame:
    """SRC-09: one row per ``<item>``; missing court/date/case number →
    'Unknown'; the cap counts items before the link filter; items without a
    link are dropped."""
    df = spark.read.format("xml").option("rowTag", "item").schema(CATALOGUE_SCHEMA).load(path)
    if max_items is not None:
        df = with_line_numbers(df.select("*", "_metadata"), "_pos", limit=max_items)
    out = df.select(F.when(F.col("gericht").isNull(), "Unknown").otherwise(F.col("gericht")).alias("court"),
                    F.when(F.col("entsch-datum").isNull(), "Unknown").otherwise(F.col("entsch-datum")).alias("date"),
                    F.when(F.col("aktenzeichen").isNull(), "Unknown").otherwise(F.col("aktenzeichen")).alias("case_number"),
                    F.col("link"))
    return out.where(F.col("link").isNotNull() & (F.col("link") != ""))


ARCHIVE_SCHEMA = "source_file string, member string, xml string, error string"


def expand_archives(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """SRC-10: first ``*.xml`` member of each ZIP (in archive order), decoded
    as UTF-8; archives without one get ``error`` (reject, not failure)."""
    return expand_archive_rows(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def expand_archive_rows(files: DataFrame) -> DataFrame:
    """``expand_archives`` for rows (path, content as bytes) of any table."""
    small_batches(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if n.endswith(".xml")]
                        if not names:
                            rows.append((p, None, None, "no XML member"))
                        else:
                            rows.append((p, names[0], z.read(names[0]).decode("utf-8"), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "member", "xml", "error"])

    return files.select("path", "content").mapInPandas(run, ARCHIVE_SCHEMA)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: one prompt per line, stripped of surrounding whitespace."""
    from ..functions.text import py_strip
    return spark.read.text(path).select(py_strip(F.col("value")).alias("prompt"))


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-14: saved splits; the split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df
