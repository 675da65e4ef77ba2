"""What the two searches share: usable vectors, equal ones as one, and answers for every id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(vec_id, v as doubles) of vectors without null or non-finite components; without empty
    ones and, unless ``zero``, all-zero ones."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad))
    return rows if zero else rows.filter(F.exists(v, lambda x: x != 0))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """A row per vector: vid (its smallest id), v, ids (its ``keep`` smallest, repeats once). No
    answer needs more: equal vectors score alike and ties go to smaller ids. The limit is applied
    in each task before rows of a vector meet, so a vector that many rows share stays small."""
    near = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("_r", F.dense_rank().over(near)).filter(F.col("_r") <= keep)
    return cut(first.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("vid", F.col("ids")[0]))


def sampled(data: DataFrame, n: int, size: int) -> DataFrame:
    """The ``size`` of the ``n`` distinct vectors whose ids have the smallest hashes. A threshold on the
    hash keeps about twice as many (64 more) before they are ordered, whatever the table's size."""
    h, span = F.pmod(F.xxhash64("vid"), F.lit(1 << 30)), 1 << 30
    least = min(span, -(-(2 * size + 64) * span // max(1, n)))
    return data.filter(h < least).orderBy(h, "vid").limit(size)


def rows_of(megabytes: int, width: int) -> int:
    """How many vectors of so many doubles fit."""
    return max(1, (megabytes << 20) // (8 * max(1, width)))


def beside(held: DataFrame, asked: DataFrame, keys: list[str], order: list[str], build: Callable, answer: Callable,
           schema: str) -> DataFrame:
    """Rows ``held`` of a key come first and are kept, as ``build`` makes them of their table; those
    ``asked`` of it then pass by in batches, each given to ``answer`` with what was built. So held
    rows are sent once, however many ask, and a task holds one key's and a batch."""
    rows = held.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, built = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            at = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, "asks"]])
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
            for begin, end in zip(starts, np.r_[starts[1:], len(at)]):
                key, asks = tuple(at[begin, :-1]), bool(at[begin, -1])
                if key != current:
                    current, parts, built = key, [], None
                if not asks:
                    parts.append(b.slice(begin, end - begin))
                elif parts or built is not None:
                    if built is None:
                        built, parts = build(pa.Table.from_batches(parts)), []
                    yield answer(built, b.slice(begin, end - begin))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "asks", *order).mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def answers(found: DataFrame, distinct_rows: DataFrame, queries: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score for every query from ``found`` (qvid, vid, s), the k + 1 best
    distinct vectors of each distinct query vector. ``queries``: (query_id, qvid)."""
    ids = distinct_rows.select("vid", "ids")
    spread = (found.join(ids, "vid").select("qvid", "s", F.explode("ids").alias("vec_id"))
              .join(queries, "qvid").filter("vec_id != query_id"))
    best = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "vec_id")
    return (spread.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", score.alias("score")))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query vector, ties to the smaller id."""
    best = Window.partitionBy("qvid").orderBy(F.col("s").desc(), "vid")
    return found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")
