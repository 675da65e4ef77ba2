"""Structured Streaming jobs (STR-01/02).

Both reuse the batch operators unchanged, so a stream run with
``trigger(availableNow=True)`` equals the batch result. Unless the caller
names one, a stream's checkpoint lies below the cluster's shared
``spark.checkpoint.dir``, in a folder of its input and output.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..operators.monitor import violation_counts, violation_result
from ..session import checkpoint_dir


BINARY_FILE_SCHEMA = TY.StructType([
    TY.StructField("path", TY.StringType()), TY.StructField("modificationTime", TY.TimestampType()),
    TY.StructField("length", TY.LongType()), TY.StructField("content", TY.BinaryType())])


def _checkpoint(spark: SparkSession, job: str, in_dir: str, out_dir: str) -> str:
    key = hashlib.md5(f"{in_dir}\n{out_dir}".encode()).hexdigest()
    return f"{checkpoint_dir(spark).rstrip('/')}/{job}-{key}"


def stream_documents(spark: SparkSession, in_dir: str, out_dir: str, language: str = "en",
                     checkpoint: str | None = None, available_now: bool = True,
                     glob: str = "*.{txt,html,htm,xml}", max_files: int = 1000, rows: bool = False):
    """STR-01: new .txt/.html/.htm/.xml files → the batch routing, decoding and
    preprocessing in one pass → a table with the partitions kind=documents and
    kind=rejects (invalid UTF-8, broken markup). A file that is delivered again
    (same name and content hash) is known from the state store and dropped;
    the state keeps a hash per file. The checkpoint tracks processed files;
    each epoch of each checkpoint has partitions of its own, which a replay
    overwrites (idempotent sink). ``max_files`` bounds a micro-batch. ``rows``:
    the folder holds Parquet tables of (source_file, content), many files each."""
    from ..sources.readers import tagged_files

    checkpoint = checkpoint or _checkpoint(spark, "stream_documents", in_dir, out_dir)
    source = spark.readStream.option("maxFilesPerTrigger", max_files)
    if rows:
        raw = source.schema("source_file string, content binary").parquet(in_dir)
    else:
        raw = source.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob).load(in_dir)
        raw = raw.select(F.col("path").alias("source_file"), "content")
    name = F.regexp_extract("source_file", r"([^/]*)$", 1)
    raw = raw.withColumn("_delivered", F.sha2(F.concat(F.encode(F.concat(name, F.lit("/")), "UTF-8"), F.col("content")), 256)).dropDuplicates(["_delivered"]).drop("_delivered")

    def query_id() -> str:
        """Of the query this checkpoint belongs to: written before its first epoch runs."""
        return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]

    def write(batch: DataFrame, epoch_id: int):
        # partitions by epoch, overwritten on replay: a retried micro-batch
        # (lost executor, restarted query) replaces its own output instead of
        # appending duplicates; epochs start anew with every checkpoint, so
        # the query's id, which the checkpoint keeps, is part of the name
        out = tagged_files(batch, language).drop("text", "normalized_text", "rejected")
        out = out.withColumns({"kind": F.when(F.col("error").isNull(), "documents").otherwise("rejects"), "epoch_id": F.lit(f"{query_id()}-{epoch_id}")})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "epoch_id").parquet(out_dir)

    w = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


EVENT_SCHEMA = TY.StructType([
    TY.StructField("event_id", TY.LongType()), TY.StructField("ts", TY.TimestampType()),
    TY.StructField("user_id", TY.LongType()), TY.StructField("event_type", TY.StringType()),
    TY.StructField("value", TY.DoubleType()), TY.StructField("props", TY.StringType())])


def stream_quality(events: DataFrame, ts_col: str = "ts", key_col: str = "event_type", value_col: str = "value",
                   window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """STR-02: hourly request quality per key; rows later than the
    watermark are dropped; append mode emits each window once."""
    return (events.withWatermark(ts_col, watermark)
            .groupBy(F.window(F.col(ts_col), window).alias("w"), F.col(key_col))
            .agg(F.count(F.lit(1)).alias("requests"), F.avg(value_col).alias("avg_value"),
                 F.max(value_col).alias("max_value"), F.sum(F.col(value_col).isNull().cast("long")).alias("missing"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key_col,
                    "requests", "avg_value", "max_value", "missing"))


def stream_violations(events: DataFrame, base: DataFrame, columns: list[str], ts_col: str = "ts", window: str = "1 hour",
                      watermark: str = "1 hour") -> DataFrame:
    """MON-02 as a stream: windowed counts of the events, joined to the baseline table; rows later
    than the watermark are dropped, and append mode emits each window once."""
    return violation_result(violation_counts(events.withWatermark(ts_col, watermark), base, ts_col, columns, window))


def _append(spark: SparkSession, windows: DataFrame, out_dir: str, checkpoint: str):
    """Closed windows of each epoch in a folder of its own, which a replay overwrites."""
    def write(batch: DataFrame, epoch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch_id={epoch_id}")

    return windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _close(spark: SparkSession, checkpoint: str, value: str) -> DataFrame:
    """The windows that are open in the state store: key columns, and ``value`` as the aggregates' fields."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value").cast(f"struct<{value}>").alias("_v")).select("*", "_v.*").drop("_v")


def _events(spark: SparkSession, events_dir: str, glob: str, max_files: int) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(events_dir)


def run_quality_stream(spark: SparkSession, events_dir: str, out_dir: str, checkpoint: str | None = None,
                       glob: str = "*.parquet", max_files: int = 1000):
    """Parquet event files → STR-02 → a table of closed windows, partitioned by epoch (availableNow).

    A window closes once the watermark has passed its end, so that state holds the open windows
    only and the newest stay open when the files run out: ``close_quality`` adds them when no more
    events will come."""
    checkpoint = checkpoint or _checkpoint(spark, "stream_quality", events_dir, out_dir)
    return _append(spark, stream_quality(_events(spark, events_dir, glob, max_files)), out_dir, checkpoint)


def close_quality(spark: SparkSession, checkpoint: str, out_dir: str, key_col: str = "event_type") -> None:
    """The windows still open in a stream that has ended, from its state store (epoch_id=end)."""
    rows = _close(spark, checkpoint, "requests: long, s: double, n: long, max_value: double, missing: long")
    rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key_col, "requests",
                (F.col("s") / F.col("n")).alias("avg_value"), "max_value", "missing").write.mode("overwrite").parquet(f"{out_dir}/epoch_id=end")


def run_violations_stream(spark: SparkSession, events_dir: str, base: DataFrame, out_dir: str, columns: list[str], checkpoint: str | None = None,
                          glob: str = "*.parquet", max_files: int = 1000):
    """Parquet event files → MON-02 against ``base`` → a table of closed windows, partitioned by epoch."""
    checkpoint = checkpoint or _checkpoint(spark, "stream_violations", events_dir, out_dir)
    return _append(spark, stream_violations(_events(spark, events_dir, glob, max_files), base, columns), out_dir, checkpoint)


def close_violations(spark: SparkSession, checkpoint: str, out_dir: str) -> None:
    """The windows still open in a violations stream that has ended (epoch_id=end)."""
    rows = _close(spark, checkpoint, "rows: long, nn: long, out_of_range: long")
    violation_result(rows).write.mode("overwrite").parquet(f"{out_dir}/epoch_id=end")
