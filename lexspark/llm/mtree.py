"""Exact largest inner products by an M-tree, searched best first.

Vectors get one more component, so that all have the largest norm (queries: zero); the largest inner
product is then the smallest distance. The upper levels of the tree are routing objects, a bounded
sample, below parents; every vector hangs below its nearest one. What hangs below an object is cut by
hash into subtrees of bounded size, each built in one task: nodes are pages of entries, an entry has an
object, its distance to the object of the node it lies in, and, unless it is a vector of the table, a
covering radius and the node below it.

A query at distance d from a node's object is no nearer than |d - e| - r to anything below an entry at
distance e with radius r: within the bound or not, that is known without computing its distance. Nodes
are visited by their least possible distance; the bound is that of the k-th best found so far and
shrinks with each page. Queries visit the subtree of the lowest bound first, then the next ``AHEAD``,
then all others that their bounds leave; subtrees are sent to their tasks once each time, and the
queries pass by them. Nothing nearer can be missed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .permutation import _lifted
from .vectors import answers, beside, best_of, distinct, matrix, rows_of, sampled, usable

CELL = 2048  # vectors to a routing object, while there are at most
ROUTES = 1024  # routing objects
MEGABYTES = 32  # of vectors in a subtree
PAGE = 256  # entries of a leaf
FAN = 16  # entries of an inner node
AHEAD = 8  # subtrees visited before the bound is taken anew
SLICE = 64  # queries whose distances to all routing objects are held at once
_SLACK = 1e-6  # of the largest norms, for rounding: bounds are taken that much wider

_ENTRY = "node int, child int, vid long, v array<double>, to_object double, radius double"


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(0, d))


class Upper:
    """The levels above the subtrees: parents, each over some routing objects."""

    def __init__(self, objects: np.ndarray, top: float):
        self.objects, self.top = objects, top
        self.parents = objects[:max(1, int(np.sqrt(len(objects))))]
        self.up = np.argmin(_distances(objects, self.parents), axis=1)
        self.to_parent = np.linalg.norm(objects - self.parents[self.up], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its nearest object and the distance. Objects that the triangle
        inequality over their parent rules out aren't looked at."""
        to = _distances(x, self.parents)
        best, far = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for p in np.argsort(to.mean(axis=0)):
            own = np.flatnonzero(self.up == p)
            low = np.abs(to[:, p, None] - self.to_parent[own]).min(axis=1)
            rows = np.flatnonzero(low <= far + _SLACK * self.top)
            if len(rows) and len(own):
                d = _distances(x[rows], self.objects[own])
                at = d.argmin(axis=1)
                near = d[np.arange(len(rows)), at]
                better = near < far[rows]
                best[rows[better]], far[rows[better]] = own[at[better]], near[better]
        return best, far

    def within(self, q: np.ndarray, bound: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Distances of the queries to the objects that may lead to something within their bounds,
        infinite for the others; ``radius``: of all that hangs below an object."""
        d = np.full((len(q), len(self.objects)), np.inf)
        to = _distances(q, self.parents)
        wide = bound + _SLACK * (np.linalg.norm(q, axis=1) + self.top)
        for p in range(len(self.parents)):
            own = np.flatnonzero(self.up == p)
            if len(own):
                cover = (self.to_parent[own] + radius[own]).max()
                rows = np.flatnonzero(to[:, p] - cover <= wide)
                low = np.abs(to[rows, p, None] - self.to_parent[own]) - radius[own]
                open_ = low <= wide[rows, None]
                rows, own = rows[open_.any(axis=1)], own[open_.any(axis=0)]
                if len(rows) and len(own):
                    d[np.ix_(rows, own)] = _distances(q[rows], self.objects[own])
        return d


def _grown(top: float, objects: np.ndarray):
    """The entries of a subtree's nodes. Node 0 lies below the routing object; a node of more than
    ``PAGE`` vectors gets ``FAN`` of them at most as objects, and each vector goes to the nearest."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vid")
        vid, v = rows.column("vid").to_numpy(), matrix(rows.column("v"))
        x, rng = _lifted(v, top), np.random.default_rng(0)
        made: list[tuple] = []  # node, child, row, distance to the node's object, radius
        todo, n_nodes = [(0, np.arange(len(x)), objects[key[0].as_py()])], 1
        while todo:
            node, own, above = todo.pop()
            if len(own) <= PAGE:
                far = np.linalg.norm(x[own] - above, axis=1)
                made.append((np.full(len(own), node), np.full(len(own), -1), own, far, np.zeros(len(own))))
                continue
            chosen = rng.choice(own, min(FAN, -(-len(own) // PAGE)), replace=False)
            near = _distances(x[own], x[chosen]).argmin(axis=1)
            if np.bincount(near).max() == len(own):  # rounding hid that rows differ: by turns
                near = np.arange(len(own)) % len(chosen)
            child, radius, kept = [], [], []
            for c, o in enumerate(chosen):
                below = own[near == c]
                if not len(below):
                    continue
                kept.append(o)
                child.append(n_nodes)
                radius.append(np.linalg.norm(x[below] - x[o], axis=1).max())
                todo.append((n_nodes, below, x[o]))
                n_nodes += 1
            made.append((np.full(len(kept), node), np.array(child), np.array(kept), np.linalg.norm(x[kept] - above, axis=1), np.array(radius)))
        node, child, row, far, radius = (np.concatenate(c) for c in zip(*made))
        return pa.table({"cell": pa.array(np.full(len(node), key[0].as_py())), "part": pa.array(np.full(len(node), key[1].as_py())),
                         "node": pa.array(node.astype(np.int32)), "child": pa.array(child.astype(np.int32)), "vid": pa.array(vid[row]),
                         "v": rows.column("v").combine_chunks().take(pa.array(row)), "to_object": pa.array(far), "radius": pa.array(radius)})

    return run


class Subtree:
    """The nodes of a subtree: entries in the order of their nodes."""

    def __init__(self, node: np.ndarray, child: np.ndarray, vid: np.ndarray, v: np.ndarray, to_object: np.ndarray, radius: np.ndarray, top: float):
        self.begin = np.searchsorted(node, np.arange(node.max() + 2))
        self.child, self.vid, self.v, self.to_object, self.radius, self.top = child, vid, v, to_object, radius, top
        self.lift = np.sqrt(np.maximum(0, top * top - (v * v).sum(axis=1)))
        self.computed = 0  # distances and products

    def best(self, q: np.ndarray, far: float, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best within ``bound``, ties to smaller ids; ``far``: distance of
        the query to the routing object."""
        norm = float(q @ q) + self.top ** 2
        slack = _SLACK * 2 * np.sqrt(norm)
        vid, s = np.zeros(0, np.int64), np.zeros(0)
        queue = [(0.0, 0, far)]
        while queue:
            low, node, d = heapq.heappop(queue)
            if low > bound + slack:
                break
            own = slice(self.begin[node], self.begin[node + 1])
            at = own.start + np.flatnonzero(np.abs(d - self.to_object[own]) - self.radius[own] <= bound + slack)
            if not len(at):
                continue
            self.computed += len(at)
            near = self.v[at] @ q  # whole numbers below 2**53: exact
            if self.child[at[0]] < 0:
                vid, s = np.concatenate([vid, self.vid[at]]), np.concatenate([s, near])
                first = np.lexsort((vid, -s))[:k]
                vid, s = vid[first], s[first]
                if len(s) == k:
                    bound = min(bound, float(np.sqrt(max(0.0, norm - 2 * s[-1]))))
            else:
                to = np.sqrt(np.maximum(0, norm - 2 * near))
                for i, d_i in zip(at, to):
                    least = max(low, d_i - self.radius[i])
                    if least <= bound + slack:
                        heapq.heappush(queue, (least, int(self.child[i]), d_i))
        return vid, s


def _built(top: float):
    return lambda t: Subtree(*(t.column(c).to_numpy() for c in ("node", "child", "vid")), matrix(t.column("v")),
                             *(t.column(c).to_numpy() for c in ("to_object", "radius")), top)


def _visited(k: int):
    def run(tree: Subtree, asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, q = asked.column("vid").to_numpy(), matrix(asked.column("v"))
        found = [tree.best(*of, k) for of in zip(q, asked.column("to_object").to_numpy(), asked.column("radius").to_numpy())]
        vid, s = (np.concatenate(c) for c in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(vid), pa.array(s.astype(np.int64))],
                                          names=["qvid", "vid", "s"])

    return run


def _descend(upper: Upper, trees: dict[str, np.ndarray], first: bool):
    """For each query the subtrees to visit, with their places by lowest bound (then distance):
    ``first`` the 1 + AHEAD lowest; otherwise those within its bound that are not in ``seen``."""
    reach = np.full(len(upper.objects), -np.inf)
    np.maximum.at(reach, trees["cell"], trees["radius"])
    numbers = trees["cell"] << 32 | trees["part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                b = whole.slice(begin, SLICE)
                v = matrix(b.column("v"))
                q = _lifted(v, None)
                bound = np.full(len(q), np.inf) if first else b.column("bound").to_numpy()
                wide = bound + _SLACK * (np.linalg.norm(q, axis=1) + upper.top)
                d = upper.within(q, bound, reach)
                rows, picked, place = [], [], []
                for i in range(len(q)):
                    far = d[i, trees["cell"]]
                    low = np.maximum(0, far - trees["radius"])
                    if first:
                        order = np.lexsort((far, low))[:1 + AHEAD]
                    else:
                        order = np.flatnonzero(np.isfinite(far) & (low <= wide[i]))
                        order = order[~np.isin(numbers[order], b.column("seen")[i].values.to_numpy())]
                    rows.append(np.full(len(order), i))
                    picked.append(order)
                    place.append(np.arange(len(order)))
                row, tree = np.concatenate(rows), np.concatenate(picked)
                far = d[row, trees["cell"][tree]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vid").take(pa.array(row)), b.column("v").take(pa.array(row)), pa.array(trees["cell"][tree]), pa.array(trees["part"][tree]),
                     pa.array(far), pa.array(np.maximum(0, far - trees["radius"][tree])), pa.array(bound[row]), pa.array(np.concatenate(place).astype(np.int32))],
                    names=["vid", "v", "cell", "part", "to_object", "low", "radius", "place"])

    return run


_VISIT = "vid long, v array<double>, cell long, part long, to_object double, low double, radius double, place int"


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest integer inner products of
    floor(``scale`` * x), for every row whose id is divisible by ``every``, among all rows but its
    own (all, if there are fewer; ties to smaller ids).

    Null and empty vectors, those with null or non-finite components and those with a null id take
    no part; zero vectors do. Equal vectors are searched once and answer with all their ids; rows
    that repeat id and vector count once. An empty table gives an empty result; further columns
    are ignored. Vectors are of one length, and their products below 2**53.

    The driver holds the routing objects (``ROUTES`` at most) and, for each subtree, its number and
    radius.
    """
    rows = usable(vectors, id_col, vec_col, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    data = distinct(rows, k + 1)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top, width = data.agg(F.count("*"), F.max(F.sqrt(norm)), F.max(F.size("v"))).first()
    queries = cut(rows.filter(F.col("vec_id") % every == 0).distinct().join(data.select("v", "vid"), "v")
                  .select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qvid"), "v"))
    if not n:
        return answers(queries.select("qvid", F.col("qvid").alias("vid"), F.lit(0).cast("long").alias("s")), data,
                       queries.select("query_id", "qvid"), k, F.col("s"))
    sample = sampled(data, n, max(1, min(ROUTES, n // CELL))).select("v").toArrow()  # at most ROUTES rows
    upper = Upper(_lifted(matrix(sample.column("v")), top), top)

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("v"), pa.array(upper.nearest(_lifted(matrix(b.column("v")), top))[0])],
                                                 names=["vid", "v", "cell"])

    hung = cut(data.select("vid", "v").mapInArrow(hang, "vid long, v array<double>, cell long"))
    parts = hung.groupBy("cell").agg(F.ceil(F.count("*") / rows_of(MEGABYTES, width)).alias("parts"))  # at most ROUTES rows
    tree = cut(hung.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts"))).drop("parts")
               .groupBy("cell", "part").applyInArrow(_grown(top, upper.objects), "cell long, part long, " + _ENTRY))
    # of the entries in a subtree's first node: what they reach
    at = (tree.filter("node = 0").groupBy("cell", "part").agg(F.max(F.col("to_object") + F.col("radius")).alias("radius"))
          .toArrow())  # a row of numbers for each subtree
    trees = {c: at.column(c).to_numpy() for c in ("cell", "part", "radius")}

    def visit(asked: DataFrame) -> DataFrame:
        return beside(tree, asked.select("cell", "part", "vid", "v", "to_object", "radius"), ["cell", "part"], ["node"],
                      _built(top), _visited(k + 1), "qvid long, vid long, s long")

    def bounds(found: DataFrame) -> DataFrame:
        """qvid and the distance that k + 1 vectors are within, from the last one's product."""
        reached = found.groupBy("qvid").agg(F.min("s").alias("s"), F.count("*").alias("n")).filter(F.col("n") > k)
        far = F.sqrt(F.greatest(F.lit(0.0), norm + F.lit(float(top) ** 2) - 2 * F.col("s")))
        return asked.join(reached.withColumnRenamed("qvid", "vid"), "vid", "left").select("vid", F.when(F.col("s").isNull(), F.lit(float("inf"))).otherwise(far).alias("bound"))

    asked = cut(queries.groupBy(F.col("qvid").alias("vid")).agg(F.first("v").alias("v")))
    ahead = cut(asked.mapInArrow(_descend(upper, trees, first=True), _VISIT))
    found = cut(best_of(visit(ahead.filter("place = 0")), k + 1))
    wide = _SLACK * (F.sqrt(norm) + F.lit(float(top)))
    nearer = ahead.filter("place > 0").drop("radius").join(bounds(found), "vid").filter(F.col("low") <= F.col("bound") + wide)
    found = cut(best_of(found.unionByName(visit(nearer.withColumnRenamed("bound", "radius"))), k + 1))
    seen = ahead.groupBy("vid").agg(F.collect_list(F.shiftleft("cell", 32).bitwiseOR(F.col("part"))).alias("seen"))  # 1 + AHEAD numbers
    others = asked.join(bounds(found), "vid").join(seen, "vid").mapInArrow(_descend(upper, trees, first=False), _VISIT)
    found = best_of(found.unionByName(visit(others)), k + 1)
    return answers(found, data, queries.select("query_id", "qvid"), k, F.col("s"))
