"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of its id. A source whose target is f copies and a fraction takes all its
documents f times, and those below a threshold of the hash once more. The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the running sum passes the
budget is refined by the next bits of the hash, and so on to its last bit. A larger budget has a
larger threshold, so mixes of growing size are nested.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, cut, from_row

LEVEL_BITS = 12  # of the hash a histogram looks at: 4,096 buckets for each source


def words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share ``total`` by weight; a target stops at ``most`` times its source's size and its excess
    is shared again by weight among the others until none is above."""
    out, open_, left = {}, {s for s in sizes if weights[s] > 0}, float(total)
    out.update({s: 0.0 for s in sizes if s not in open_})
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > most * sizes[s]}
        if not full:
            out.update({s: share * weights[s] for s in open_})
            break
        out.update({s: float(most * sizes[s]) for s in full})
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def cycled(weights: Sequence[float]) -> Callable[[list], dict]:
    """Weights for the sources by code point, null last, repeating."""
    def of(sources: list) -> dict:
        order = sorted(sources, key=lambda s: (s is None, s or ""))
        return {s: weights[k % len(weights)] for k, s in enumerate(order)}

    return of


def _chosen(column: Column, values: dict, default) -> Column:
    """``values[column]`` as an expression; the sources are few."""
    out = F.lit(default)
    for s, v in values.items():
        out = F.when(column.eqNullSafe(F.lit(s)), F.lit(v)).otherwise(out)
    return out


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _hash(id_: Column, row_hash: Column) -> Column:
    return F.xxhash64(id_, row_hash)


def plan(docs: DataFrame, weights: Callable[[list], dict], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
         source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, dict, dict, Callable[[Column, Column], Column]]:
    """The sized rows, each source's size and target, and an expression of (source, hash) for the
    number of copies. The driver holds one row per source and a histogram of at most 4,096 buckets
    for each: sources are the mix's own list, not a column that grows with the data."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), _row_hash(docs).alias("row_hash"), F.col(source_col).alias("source"),
                            words(F.col(text_col)).alias("size")).withColumn("h", _hash(F.col("doc_id"), F.col("row_hash"))))
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights(list(sizes)), share * sum(sizes.values()), most)
    whole = {s: min(int(goal[s] // n), int(most)) if n else 0 for s, n in sizes.items()}
    below = _thresholds(sized, {s: goal[s] - whole[s] * n for s, n in sizes.items() if whole[s] < most})

    def copies(source: Column, h: Column) -> Column:
        return (_chosen(source, whole, 0) + (_rank(h) < _chosen(source, below, 0)).cast("int")).cast("int")

    return sized, sizes, goal, copies


def mix(docs: DataFrame, weights: Callable[[list], dict], share: float = 1.5, most: float = 2.0, **columns) -> DataFrame:
    """A row per row of ``docs``: doc_id, row_hash, source, size, source_size, target, copies, taken.

    ``weights`` gives every source's weight; all targets together are ``share`` of all sizes.
    taken is size times copies. A source's takings differ from its target by at most half the size
    of the document at the threshold. Rows alike in every column share a hash and are taken
    alike; rows that share an id alone, null ids included, are told apart by the rest of the row.
    A null source is a source, null and empty texts have size 0, and an empty table stays empty.
    """
    sized, sizes, goal, copies = plan(docs, weights, share, most, **columns)
    source = F.col("source")
    out = sized.withColumns({"source_size": _chosen(source, sizes, 0).cast("long"), "target": _chosen(source, goal, 0.0).cast("double"),
                             "copies": copies(source, F.col("h"))})
    return out.withColumn("taken", (F.col("size") * F.col("copies")).cast("long")).drop("h")


def mixed(docs: DataFrame, weights: Callable[[list], dict], share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``mix`` takes it, by a filter: no row is shuffled."""
    _, _, _, copies = plan(docs, weights, share, most, id_col, source_col, text_col)
    times = copies(F.col(source_col), _hash(F.col(id_col), _row_hash(docs)))
    rows = docs.select(as_row(docs).alias("row"), times.alias("n")).filter("n > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*from_row(docs))


def _rank(h: Column) -> Column:
    """The upper 60 bits of the hash as a whole number from 0."""
    return F.shiftrightunsigned(h, 4)


def _thresholds(sized: DataFrame, budgets: dict) -> dict:
    """For every source the ``_rank`` below which the sizes add up nearest to its budget."""
    found = {s: 0 for s in budgets}
    left = dict(budgets)
    bits = 60
    while left and bits:
        bits -= LEVEL_BITS
        source, rank = F.col("source"), _rank(F.col("h"))
        inside = sized if bits + LEVEL_BITS == 60 else sized.filter(
            F.shiftright(rank, bits + LEVEL_BITS) == _chosen(source, {s: found[s] >> (bits + LEVEL_BITS) for s in left}, -1))
        bucket = F.shiftright(rank, bits)
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size"), F.min(rank), F.max(rank))
        rows: dict = {}
        for s, *row in histogram.collect():  # at most 4,096 rows for each source
            rows.setdefault(s, []).append(row)
        for s in list(left):
            for b, n, first, last in sorted(rows.get(s, [])):
                if n <= left[s]:
                    left[s] -= n
                elif first < last:  # the boundary bucket: the next histogram looks into it
                    found[s] = b << bits
                    break
                else:  # one hash: taken if that comes nearer
                    found[s] = first + (n - left[s] < left[s])
                    del left[s]
                    break
            else:  # all that is left fits
                found[s] = ((found[s] >> (bits + LEVEL_BITS)) + 1) << (bits + LEVEL_BITS)
                del left[s]
    return found
