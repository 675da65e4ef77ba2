"""Ranked lexical search over trees of documents whose paths are frequent terms.

A document is a vector of the terms that queries ask for, most frequent first. In a block of
documents, vectors that begin alike share the path of a tree; a node keeps the largest tf of every
term below it and the smallest m, which bound the score of any document below for each item. The
tree is walked depth first for all items at once; an item leaves a subtree as soon as its bound
there is below the last of its best documents so far, and a subtree without items is not entered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import bytes_in, tokens_of

TERM = bytes_in("0123456789", (65, 90), (97, 122), (128, 255))
ITEM_TERMS = 1 << 18  # terms of the items of one block, over which the documents are searched together
BLOCK = 1 << 14  # documents of one tree
DEPTH = 24  # terms of a path; further ones lie in its leaf
LEAF = 64  # documents of a leaf, unless their paths are alike to the end
_END = np.iinfo(np.int32).max


@dataclass
class Items:
    """Queries as a sparse matrix: weight times occurrences, by item and by term."""

    ids: list
    start: np.ndarray  # of each item's entries
    term: np.ndarray
    weight: np.ndarray
    by_term: np.ndarray  # start of each term's entries among those below
    item: np.ndarray
    term_weight: np.ndarray

    @staticmethod
    def of(ids: list, item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> Items:
        order = np.argsort(term, kind="stable")
        return Items(ids, np.searchsorted(item, np.arange(len(ids))), term, weight, np.searchsorted(term[order], np.arange(n_terms + 1)), item[order], weight[order])


def _saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _vectors(vocabulary: np.ndarray):
    """doc_id, number of terms, and the wanted terms with their tf."""
    order = np.argsort(vocabulary).astype(np.int32)
    known = vocabulary[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            t = tokens_of(batch.column("text"), TERM)
            at = np.minimum(np.searchsorted(known, t.hash), max(0, len(known) - 1))
            hit = known[at] == t.hash if len(known) else np.zeros(len(t.hash), bool)
            code, tf = np.unique(t.row[hit] * len(known) + order[at[hit]], return_counts=True)
            cuts = np.searchsorted(code, np.arange(rows + 1) * len(known)).astype(np.int32)
            n = np.bincount(t.row, minlength=rows)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (code % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def _counts(n_terms: int):
    """Documents with each term, one row per term and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    return run


class Tree:
    """The documents of one block. ``rank``: place of every term by falling document frequency."""

    def __init__(self, start: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, rank: np.ndarray):
        doc = np.repeat(np.arange(len(m)), np.diff(start))
        order = np.lexsort((rank[term], doc))
        term, tf = term[order], tf[order]
        paths = np.full((DEPTH, len(m)), _END, np.int32)
        place = np.arange(len(term)) - start[doc]
        head = place < DEPTH
        paths[place[head], doc[head]] = rank[term[head]]
        by_path = np.lexsort(paths[::-1])
        size = np.diff(start)[by_path]
        self.start = np.concatenate(([0], np.cumsum(size)))
        src = np.repeat(start[:-1][by_path] - self.start[:-1], size) + np.arange(self.start[-1])
        self.term, self.tf, self.m, self.docs, self.paths = term[src], tf[src].astype(np.int64), m[by_path], by_path, paths[:, by_path]
        self.n_terms = len(rank)

    def bounds_of(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Terms below a node, the largest tf of each and the smallest m."""
        a, b = self.start[low], self.start[high]
        most = np.zeros(self.n_terms, np.int64)
        np.maximum.at(most, self.term[a:b], self.tf[a:b])
        terms = np.flatnonzero(most)
        return terms, most[terms], int(self.m[low:high].min())

    def children(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """Documents that go on with one term; small neighbours are one leaf (depth ``DEPTH``)."""
        cuts = np.concatenate(([low], low + 1 + np.flatnonzero(np.diff(self.paths[depth, low:high])), [high]))
        out: list[tuple[int, int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            deeper = DEPTH if b - a <= LEAF or self.paths[depth, a] == _END else depth + 1
            if deeper == DEPTH and out and out[-1][2] == DEPTH and b - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], b, DEPTH)
            else:
                out.append((a, b, deeper))
        return out


class _Best:
    """The best documents of every item so far, as (score descending, null ids last, id)."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.found: list[list[tuple]] = [[] for _ in items.ids]
        self.least = np.ones(len(items.ids), np.int64)  # what a document must score

    def search(self, tree: Tree, ids: list) -> None:
        everyone = np.ones(len(self.least), bool)
        stack = [(0, len(tree.m), 0)]
        while stack:
            low, high, depth = stack.pop()
            alive = self.bounds(tree, low, high) >= self.least
            if not alive.any():
                continue
            if depth < DEPTH and high - low > LEAF:
                stack += tree.children(low, high, depth)[::-1]
            else:
                for a in range(low, high, LEAF):  # documents on one path
                    self.score(tree, a, min(high, a + LEAF), alive if high - low <= LEAF else everyone, ids)

    def bounds(self, tree: Tree, low: int, high: int) -> np.ndarray:
        terms, most, m = tree.bounds_of(low, high)
        reach = np.zeros(tree.n_terms, np.int64)
        reach[terms] = _saturated(most, m)
        return np.add.reduceat(self.items.weight * reach[self.items.term], self.items.start)

    def score(self, tree: Tree, low: int, high: int, alive: np.ndarray, ids: list) -> None:
        a, b = tree.start[low], tree.start[high]
        doc = np.repeat(np.arange(high - low), np.diff(tree.start[low:high + 1]))
        part = _saturated(tree.tf[a:b], tree.m[low:high][doc])
        first, size = self.items.by_term[tree.term[a:b]], np.diff(self.items.by_term)[tree.term[a:b]]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        item = self.items.item[at]
        keep = alive[item]
        scores = np.zeros((len(self.least), high - low), np.int64)
        np.add.at(scores, (item[keep], np.repeat(doc, size)[keep]), (self.items.term_weight[at] * np.repeat(part, size))[keep])
        good = scores >= self.least[:, None]
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            new = [(-int(scores[i, d]), ids[tree.docs[low + d]] is None, ids[tree.docs[low + d]] or 0) for d in np.flatnonzero(good[i]).tolist()]
            self.found[i] = sorted(self.found[i] + new)[:self.k]
            if len(self.found[i]) == self.k:
                self.least[i] = -self.found[i][-1][0]


def _search(items: Items, rank: np.ndarray, n_docs: int, n_words: int, k: int):
    """The best of each item among a task's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(items, k)
        held: list[pa.RecordBatch] = []
        size = 0

        def search() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            terms = t.column("terms").combine_chunks()
            start = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy())))
            # no 64-bit number passes: 75 n N is below 2**63 for a text of 10**6 terms and 10**11 documents
            m = 25 + 75 * t.column("n").to_numpy() * n_docs // n_words
            best.search(Tree(start, terms.flatten().to_numpy(), t.column("tfs").combine_chunks().flatten().to_numpy(), m, rank), t.column("doc_id").to_pylist())

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    search()
                    held, size = [], 0
        if held:
            search()
        rows = [(i, items.ids[i], None if null else doc, -score) for i, found in enumerate(best.found) for score, null, doc in found]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = tokens_of(batch.column("text"), TERM)
        code, at, n = np.unique(np.stack([t.row.view(np.uint64), t.hash]), axis=1, return_index=True, return_counts=True)
        row = t.row[at]
        yield pa.RecordBatch.from_arrays([batch.column("number").take(pa.array(row)), batch.column("item_id").take(pa.array(row)), pa.array(code[1].view(np.int64)), pa.array(n)],
                                         names=["number", "item_id", "h", "n"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` documents with the highest score above 0 for
    every item; equal scores by doc_id, null ids last.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A to Z
    lower-cased, known by 64-bit hashes. Null and empty texts, and texts without a term, are no
    documents and no items; rows alike in id and text are one item, but as many documents; equal
    item ids with different texts are ranked by themselves. Empty tables give an empty result;
    further columns are ignored.

    Items are asked in blocks of ``ITEM_TERMS`` terms, each block over all documents.
    """
    small_batches(docs.sparkSession)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    terms = written(asked.withColumn("number", F.xxhash64("item_id", F.coalesce("text", F.lit("")))).mapInArrow(_item_terms, "number long, item_id long, h long, n long"), "items")
    blocks = max(1, -(-2 * terms.count() // ITEM_TERMS))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in range(blocks):
        found = _best_of(texts, terms.filter(F.pmod("number", F.lit(blocks)) == block) if blocks > 1 else terms, k)
        out = found if out is None else out.unionByName(found)
    return out


def _best_of(texts: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    asked = terms.orderBy("number", "item_id", "h").toArrow()  # about ITEM_TERMS rows at most
    vocabulary, term = np.unique(asked.column("h").to_numpy().view(np.uint64), return_inverse=True)
    item = np.unique(asked.column("number").to_numpy(), return_inverse=True)[1]
    first = np.searchsorted(item, np.arange(item.max(initial=-1) + 1))
    ids = [asked.column("item_id")[int(i)].as_py() for i in first]

    vectors = written(texts.mapInArrow(_vectors(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), "vectors")
    n_docs, n_words = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = vectors.select("terms").mapInArrow(_counts(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary), np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    idf = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    listed = Items.of(ids, item, term, asked.column("n").to_numpy() * idf[term] if asked.num_rows else term, len(vocabulary))

    rows = vectors.filter(F.size("terms") > 0).mapInArrow(_search(listed, rank, n_docs, max(1, n_words), k), "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def oracle_sql(k: int = 10) -> str:
    """The same result in DuckDB SQL, by scoring every document that holds a term."""
    def terms(text: str) -> str:
        return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

    return f"""WITH d AS (SELECT doc_id, {terms('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({terms('text')}) AS t FROM benchmark) AS b GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) AS x WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
r AS (SELECT q.item_id, p.doc_id, CAST(sum(q.c * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * s.nn) // s.ll)))) AS BIGINT) AS score
  FROM q JOIN p ON p.t = q.t JOIN w ON w.t = q.t, s GROUP BY q.item_id, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= {k}"""
