"""Approximate nearest neighbours (largest inner product) by a permutation index.

A vector is represented by its nearest pivots in order. Each block of vectors keeps inverted files:
for every pivot, the vectors that have it in their orders, and where. A query adds up, over the files
of its own nearest pivots, how much nearer each vector posted there comes by footrule distance; the
best share of every block is scored exactly. Vectors are sent to their block once; the queries pass
by them in batches.

Vectors get one more component, so that all have the largest norm (queries: zero); the nearest by
distance are then those of the largest inner product, whatever the norms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import answers, beside, best_of, distinct, matrix, rows_of, sampled, usable

PIVOTS = 256  # sampled vectors, by the smallest hashes of their ids
NEAREST = 64  # of them in a vector's order
SHARE = 0.15  # of a block's vectors that are scored exactly, and at least so many:
LEAST = 128
MEGABYTES = 8  # of vectors in a block


def _lifted(x: np.ndarray, top: float | None) -> np.ndarray:
    """With one more component: up to norm ``top`` for vectors, zero for queries (None)."""
    more = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))
    return np.column_stack([x, more])


def _orders(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The nearest pivots of every row, nearest first, ties to the lower number."""
    far = (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argsort(far, axis=1, kind="stable")[:, :nearest].astype(np.uint16)


class Block:
    """Vectors of a block with the inverted files of the pivots in their orders."""

    def __init__(self, vid: np.ndarray, x: np.ndarray, order: np.ndarray, n_pivots: int):
        self.vid, self.x = vid, x
        self.nearest = order.shape[1]
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.rows = by_pivot // self.nearest
        self.gain = (self.nearest - by_pivot % self.nearest).astype(np.uint16)  # nearest less the pivot's place
        self.begin = np.searchsorted(order.ravel()[by_pivot], np.arange(n_pivots + 1))

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector's order to this one, pivots absent from one in place
        ``nearest``: it is nearest * (nearest + 1) less twice this sum."""
        near = np.zeros(len(self.vid), np.uint32)
        for place, p in enumerate(order):
            a, b = self.begin[p], self.begin[p + 1]
            near[self.rows[a:b]] += np.minimum(self.gain[a:b], np.uint16(self.nearest - place))
        return near

    def best(self, q: np.ndarray, order: np.ndarray, k: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best of the ``take`` nearest, and of all that tie with the last of these."""
        near = self.nearness(order)
        at = np.flatnonzero(near >= np.partition(near, len(near) - take)[len(near) - take])
        s = np.einsum("ij,j->i", self.x[at], q)
        first = np.lexsort((self.vid[at], -s))[:k]
        return at[first], s[first]


def _built(n_pivots: int):
    return lambda t: Block(t.column("vid").to_numpy(), matrix(t.column("v")), matrix(t.column("pivots")).astype(np.int64), n_pivots)


def _answered(k: int, share: float, least: int):
    def run(block: Block, asked: pa.RecordBatch) -> pa.RecordBatch:
        take = min(len(block.vid), max(least, int(np.ceil(share * len(block.vid)))))
        found = [block.best(q, order, k, take) for q, order in zip(matrix(asked.column("v")), matrix(asked.column("pivots")).astype(np.int64))]
        at, s = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.column("vid").to_numpy(), [len(f[0]) for f in found])),
                                           pa.array(block.vid[at]), pa.array(s)], names=["qvid", "vid", "s"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           n_pivots: int = PIVOTS, nearest: int = NEAREST, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for every row whose id is
    divisible by ``every``, among all rows but its own; all, if there are fewer.

    All rows are indexed; the pivots alone are a sample of ``n_pivots`` distinct vectors. Null and
    empty vectors, zero vectors, those with null or non-finite components and those with a null id
    take no part. Equal vectors are searched once and answer with all their ids, smaller ids
    first; rows that repeat id and vector count once. An empty table gives an empty result;
    further columns are ignored. Vectors are of one length.
    """
    rows = usable(vectors, id_col, vec_col, zero=False)
    data = distinct(rows, k + 1)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, top, width = data.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    sample = sampled(data, n, n_pivots).select("v").toArrow()  # n_pivots rows
    pivots = _lifted(matrix(sample.column("v")), top or 0.0)
    near = min(nearest, max(1, len(pivots) // 2))

    def ordered(lift: float | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    order = _orders(_lifted(matrix(b.column("v")), lift), pivots, near)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * near, pa.int32()), pa.array(order.ravel().astype(np.int16)))
                    yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("v"), lists], names=["vid", "v", "pivots"])

        return run

    queries = cut(rows.filter(F.col("vec_id") % every == 0).distinct().join(data.select("v", "vid"), "v")
                  .select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qvid"), "v"))
    asked = queries.groupBy(F.col("qvid").alias("vid")).agg(F.first("v").alias("v"))
    blocks = max(1, -(-n // rows_of(MEGABYTES, width or 1)))
    schema = "vid long, v array<double>, pivots array<short>"
    left = (data.select("vid", "v").mapInArrow(ordered(top or 0.0), schema)
            .withColumn("block", F.pmod(F.xxhash64("vid"), F.lit(blocks))))
    right = (asked.select("vid", "v").mapInArrow(ordered(None), schema)
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    found = beside(left, right, ["block"], [], _built(len(pivots)), _answered(k + 1, share, least), "qvid long, vid long, s double")
    return answers(best_of(found, k + 1), data, queries.select("query_id", "qvid"), k, F.col("s"))
