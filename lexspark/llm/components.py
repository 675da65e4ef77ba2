"""Connected components by alternating star contraction.

Each round hangs every node on the smallest node it sees (large star: neighbours above the node;
small star: the node and its neighbours below). The edges stay rows of a table: a hot node's edges
are pre-aggregated to one minimum and joined back, which skew-join splitting can deal out. Rounds
are many and mostly short, so edges lie in as few partitions as their number asks for, not in one
for each shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PART_ROWS = 1 << 19  # edges of a partition


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One contraction of rows (u, v), u > v."""
    sides = (edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges).coalesce(parts)
    low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = sides.join(low, "u").filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m"))
    out = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts)
    return out.filter("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge: the smallest node reachable.

    links: two columns of one comparable type; null ends, loops and repeated edges do no harm.
    """
    edges = cut(links.filter(F.col(a) != F.col(b))
                .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state, parts = None, max(1, -(-edges.count() // PART_ROWS))  # no round adds edges
    while True:
        edges = edges.coalesce(parts)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.xxhash64("v") % (1 << 40))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        edges = cut(_star(_star(edges, True, parts), False, parts))
