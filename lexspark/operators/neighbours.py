"""Nearest documents by shared authorities (CIT-12): the top partners of every
document, weighted by how rare what they share is, without a list of pairs.

An authority that many documents cite would pair them all. So candidates come
from rare authorities only (cited by ``most`` documents at most) and get their
whole score. Another partner can share hot authorities alone, so its score is
at most the weight of a document's hot ones: a document whose last candidate
scores more is done. For the others the distinct sets of hot authorities are
scored against each other in blocks, where only the best of each set leave the
task; a set stands for its documents with the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .citations import citation_edges
from .skew import salted_join

MOST = 1000  # documents that cite a rare authority
BLOCK, QUERY_BLOCK = 8192, 1024  # distinct sets of a block
PAIRS = 1 << 19  # pairs of documents, or sets of blocks, that a task holds


def _score_block(k: int):
    def run(sets: pa.Table, asked: pa.Table) -> pa.Table:
        """The ``k`` best sets for each set asked, by score and smallest id."""
        out: list[tuple[int, int, int, int]] = []
        posts: dict[str, list[int]] = {}
        for i, hot in enumerate(sets.column("hot").to_pylist()):
            for h in hot:
                posts.setdefault(h["authority"], []).append(i)
        lists = {a: np.array(p) for a, p in posts.items()}
        cls, first = sets.column("cls").to_numpy(), sets.column("first").to_numpy()
        for q, hot in zip(asked.column("qcls").to_pylist(), asked.column("hot").to_pylist()):
            score = np.zeros(len(cls), np.int64)
            for h in hot:
                if h["authority"] in lists:
                    score[lists[h["authority"]]] += h["w"]
            best = np.lexsort((first, -score))[:k]
            out += [(q, int(cls[i]), int(score[i]), int(first[i])) for i in best if score[i] > 0]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], [], []))], names=["qcls", "cls", "score", "first"])

    return run


def _best(df: DataFrame, key: str, k: int, then: str = "partner") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), then)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tasks(rows: int) -> int:
    return max(1, -(-rows // PAIRS))


def nearest_by_authorities(df: DataFrame, k: int = 10, id_col: str = "doc_id", cit_col: str = "citations", most: int = MOST) -> DataFrame:
    """``id_col``, rank (from 1), partner, score: the ``k`` documents (fewer, if fewer share anything)
    with the largest weight of shared authorities, ties to smaller ids. An authority weighs
    floor(1000 ln((N + 1) / documents that cite it)), N being the documents that cite anything.
    Ids are distinct numbers; documents without citations have no rows."""
    edges = kept(citation_edges(df, id_col, cit_col).select(F.col(id_col).cast("long").alias("id"), "authority"), "edges")
    n = edges.agg(F.count_distinct("id")).scalar()
    stats = edges.groupBy("authority").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    stats = stats.withColumn("w", F.floor(1000 * F.ln((n + 1) / F.col("df"))))
    weighed = kept(salted_join(edges, stats, "authority", ["id"]), "weighed")
    hot = kept(weighed.where(F.col("df") > most).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("authority", "w"))).alias("hot"), F.sum("w").alias("reach")), "hot")

    # few rows make many pairs: partitions go by these, which a partition's bytes before the join don't tell
    parts = _tasks(weighed.where(F.col("df") <= most).agg(F.coalesce(F.sum(F.col("df") - 1), F.lit(0))).first()[0])
    rare = weighed.where(F.col("df") <= most).select("id", "authority", "w").repartition(parts, "authority")
    pairs = (rare.join(rare.select(F.col("id").alias("partner"), "authority"), "authority").where("id != partner")
             .repartition(parts, "id").groupBy("id", "partner").agg(F.sum("w").alias("rare")))
    other = hot.select(F.col("id").alias("partner"), F.transform("hot", lambda h: h["authority"]).alias("_names"))
    pairs = pairs.join(hot.select("id", "hot"), "id", "left").repartition(parts, "partner").join(other, "partner", "left")
    shared = F.aggregate(F.filter("hot", lambda h: F.array_contains("_names", h["authority"])), F.lit(0).cast("long"), lambda a, h: a + h["w"])
    found = kept(_best(pairs.select("id", "partner", (F.col("rare") + F.coalesce(shared, F.lit(0))).alias("score")).where("score > 0").repartition(parts, "id"), "id", k).drop("rank"), "found")

    last = found.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_last"))
    sets = hot.withColumn("cls", F.xxhash64(F.array_join(F.transform("hot", lambda h: h["authority"]), "\u0000")))
    undone = kept(sets.join(last, "id", "left").where((F.coalesce("_n", F.lit(0)) < k) | (F.col("_last") <= F.col("reach"))).select("id", "cls", "hot"), "undone")
    near = Window.partitionBy("cls").orderBy("id")
    members = kept(sets.select("cls", "id").withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1).drop("_r"), "members")
    classes = kept(sets.groupBy("cls").agg(F.min("id").alias("first"), F.first("hot").alias("hot")), "classes")
    asked = undone.groupBy(F.col("cls").alias("qcls")).agg(F.first("hot").alias("hot"))
    blocks, q_blocks = max(1, -(-classes.count() // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    left = classes.withColumn("block", F.pmod("cls", F.lit(blocks))).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    right = asked.withColumn("q_block", F.pmod("qcls", F.lit(q_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tasks = min(1 << 14, max(_tasks(blocks * q_blocks * BLOCK), 1))
    left, right = (x.repartition(tasks, "block", "q_block") for x in (left, right))
    best = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block")).applyInArrow(_score_block(k + 1), "qcls long, cls long, score long, first long")
    best = _best(best, "qcls", k + 1, "first").select("qcls", "cls", "score")  # the k + 1 best sets hold the k + 1 best documents
    spread = _best(best.join(members.withColumnRenamed("id", "partner"), "cls").select("qcls", "partner", "score"), "qcls", k + 1).drop("rank")
    more = undone.select("id", F.col("cls").alias("qcls")).join(spread, "qcls").where("id != partner").select("id", "partner", "score")
    whole = found.unionByName(more).groupBy("id", "partner").agg(F.max("score").alias("score"))
    return _best(whole, "id", k).select(F.col("id").alias(id_col), "rank", "partner", "score")
