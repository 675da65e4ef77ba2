"""Writers (SNK-01..11). Distributed writers only: every sink is a
``DataFrameWriter`` on a directory (local, HDFS, s3a://…); no file is
assembled on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions.text import path_key
from ..session import kept


def write_docs(df: DataFrame, path: str, key_col: str = "source_file", mode: str = "overwrite") -> None:
    """SNK-01: processed documents as JSON records with ``doc_key`` = source
    basename + '.json' (one record per document, not one file per row)."""
    key = F.concat(F.regexp_extract(F.col(key_col), r"([^/]+)$", 1), F.lit(".json"))
    df.withColumn("doc_key", key).write.mode(mode).json(path)


def write_task_examples(df: DataFrame, path: str, task_col: str = "task", mode: str = "overwrite") -> None:
    """SNK-02: one record per (document, task), partitioned by task."""
    df.write.mode(mode).partitionBy(task_col).json(path)


def write_examples(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-03: JSONL, non-ASCII kept (Spark writes UTF-8 unescaped)."""
    df.write.mode(mode).json(path)


def write_splits_jsonl(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """SNK-04."""
    df.write.mode(mode).partitionBy(split_col).json(path)


def write_manifest(manifest: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-05: the AGG-08 manifest, one JSON object per split."""
    manifest.write.mode(mode).partitionBy("split").json(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """SNK-06: columnar splits, partitioned by split (SRC-14 prunes on it)."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def _path(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_manifest(spark: SparkSession, uri: str) -> DataFrame:
    """file (below ``uri``), length and sha256 of every data file, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(uri)
    below = F.substring_index("path", f"{uri.rstrip('/').rpartition('/')[2]}/", -1)
    return files.select("path", below.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def publish(df: DataFrame, uri: str, split_col: str = "split", fmt: str = "json",
            splits=("train", "validation", "test")) -> dict:
    """SNK-07: publish under a prefix on any Hadoop URI; returns split → URI.

    Each publish writes a version folder of its own with a manifest of file hashes; what counts is
    the marker ``CURRENT``, which is replaced by one rename when all that is written. A reader
    (``published``) sees the old version or the new one, and a publish that fails changes nothing."""
    spark = df.sparkSession
    version = f"versions/{uuid.uuid4().hex}"
    base = f"{uri.rstrip('/')}/{version}"
    df.write.mode("error").partitionBy(split_col).format(fmt).save(f"{base}/data")
    file_manifest(spark, f"{base}/data").drop("path").write.json(f"{base}/manifest")
    _mark(spark, uri, version)
    return {s: f"{base}/data/{split_col}={s}" for s in splits}


def _mark(spark: SparkSession, uri: str, version: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, fs = _path(spark, f"{uri.rstrip('/')}/_marker-{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    current, _ = _path(spark, f"{uri.rstrip('/')}/CURRENT")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(current), overwrite)


def published(spark: SparkSession, uri: str) -> str | None:
    """The folder of the version that a reader should see; None before the first publish."""
    path, fs = _path(spark, f"{uri.rstrip('/')}/CURRENT")
    if not fs.exists(path):
        return None
    return f"{uri.rstrip('/')}/{spark.read.text(path.toString(), wholetext=True).first()[0]}/data"


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and order-insensitive content hash (sum of per-row xxhash64)."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("hash_sum"))


def snapshot(spark: SparkSession, uri: str, version: str, fmt: str = "parquet") -> dict:
    """SNK-08: a version of a dataset in ``<uri>-snapshots``. Rows are stored by the hash of the file
    they come from, so a version copies only files that no earlier one has; its manifest, written
    last, is what makes it a version (``read_snapshot``). Row count and content hash are verified
    against the source first. Returns version, rows, copied (files) and verified."""
    target = f"{uri.rstrip('/')}-snapshots"
    files = kept(file_manifest(spark, uri), "manifest")
    known = _stored(spark, target)
    new = files if known is None else files.join(known, "sha256", "left_anti")
    paths = [r["path"] for r in new.groupBy("sha256").agg(F.min("path").alias("path")).collect()]  # a row per changed file
    src = spark.read.format(fmt).load(uri)
    if paths:
        rows = spark.read.format(fmt).schema(src.schema).option("basePath", uri).load(paths).select("*", F.col("_metadata.file_path").alias("_path"))
        named = rows.join(new.select(F.col("path").alias("_path"), F.col("sha256").alias("_file")), "_path").drop("_path")
        named.write.mode("append").partitionBy("_file").format(fmt).save(f"{target}/data")
    manifest = files.select("file", "length", "sha256")
    found = _of_manifest(spark, target, manifest, fmt, src.schema)
    a, b = table_fingerprint(src.select(*src.columns)).first(), table_fingerprint(found.select(*src.columns)).first()
    if a == b:
        manifest.write.mode("error").json(f"{target}/manifests/version={version}")
    return {"version": version, "rows": a["rows"], "copied": len(paths), "verified": a == b}


def _stored(spark: SparkSession, target: str) -> DataFrame | None:
    """Hashes of all files that some version has."""
    path, fs = _path(spark, f"{target}/manifests")
    return spark.read.schema("sha256 string").json(f"{target}/manifests/*").distinct() if fs.exists(path) else None


def _of_manifest(spark: SparkSession, target: str, manifest: DataFrame, fmt: str, schema) -> DataFrame:
    data = spark.read.format(fmt).schema(TY.StructType([*schema.fields, TY.StructField("_file", TY.StringType())])).load(f"{target}/data")
    times = manifest.groupBy(F.col("sha256").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))  # files of equal content count each
    return data.join(times, "_file").select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_file", "_n", "col")


def read_snapshot(spark: SparkSession, uri: str, version: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """The rows of a version, as long as its manifest is there."""
    target = f"{uri.rstrip('/')}-snapshots"
    schema = schema or spark.read.format(fmt).load(f"{target}/data").drop("_file").schema
    return _of_manifest(spark, target, spark.read.schema("file string, length long, sha256 string").json(f"{target}/manifests/version={version}"), fmt, schema)


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-09."""
    df.write.mode(mode).json(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-10: the long (metric, value) table."""
    df.repartition(1).write.mode(mode).json(path)  # a handful of rows; what makes them keeps its tasks


__all__ = ["write_docs", "write_task_examples", "write_examples", "write_splits_jsonl", "write_manifest",
           "write_splits", "publish", "published", "snapshot", "read_snapshot", "file_manifest", "table_fingerprint", "write_predictions", "write_metrics",
           "path_key"]
