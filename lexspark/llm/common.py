"""Helpers shared by the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_folder, small_batches as small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of ``spark.checkpoint.dir``: lost executors don't
    lose it, and Spark removes it with the frame (``cleanCheckpoints``). Without that setting a
    scratch folder serves, on a ``local`` master only."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    with _no_shuffles_left(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # the setting counts when a frame is made


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a compressed table in the shared folder, which goes with the session: for
    larger frames than ``cut``, whose checkpoints are not compressed."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    with _no_shuffles_left(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a frame that ``written`` made and nothing reads again."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _no_shuffles_left(spark: SparkSession):
    """Once the rows are written, the shuffles that made them are of no use."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def as_row(df: DataFrame) -> Column:
    """All columns as one, so that names of an operator's own can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def from_row(df: DataFrame, row: str = "row", **changed: Column) -> list[Column]:
    """The columns of ``df`` out of ``as_row``, some of them changed."""
    return [changed.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in df.columns]


def run_stages(spark: SparkSession, stages, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet to the shared folder and read again by the next; the
    files go with the session."""
    base = scratch_folder(spark, "stages")
    for k, (_, stage) in enumerate(stages):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
