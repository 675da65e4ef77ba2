"""SimHash near-duplicates: fingerprints, deletion-variant index, components.

Fingerprint. The UTF-8 text with A-Z lower-cased is cut into words at ASCII white space; every
``shingle`` consecutive words (repeats count) are joined by one space and hashed by XXH64 with
seed 42. Bit i of the fingerprint is set if it is set in more than half of the hashes. A text with
fewer words is one shingle; without words the fingerprint is zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, cut, from_row, small_batches
from .components import components

_BLOCK = 1 << 14  # hashes whose bits are unpacked at once


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + _BLOCK], stops[at:at + _BLOCK])],
                     dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.int64))


def fingerprint_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return run(text)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of ``max_bits // 2 + 1`` segments: if each differed in two bits or more, a pair
    would differ in more than ``max_bits``, so one differs in at most one bit."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) at most ``max_bits`` apart.

    Every segment yields one signature for each of its bits, that bit taken as a wildcard; equal
    signatures meet in an equality join whose condition verifies the distance. A pair meets under
    many signatures: it is taken from the first segment in which it differs by a bit at most, under
    the wildcard of that bit (the segment's first, if it doesn't differ), so each link is one row.
    """
    at = segments(max_bits)
    masks = [((1 << w) - 1) << s for s, w in at]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = []
    for k, (s, w) in enumerate(at):
        for j in range(w):
            kept = masks[k] & ~(1 << (s + j))
            kept = kept - (1 << 64) if kept >> 63 else kept
            variants.append(F.struct(F.lit(s + j).alias("bit"), F.lit(k).alias("segment"),
                                     F.col("fp").bitwiseAND(F.lit(kept)).alias("rest")))
    index = prints.select("fp", F.explode(F.array(*variants)).alias("x")).select("fp", "x.*")
    a, b = index.alias("a"), index.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    here, first = F.lit(False), F.lit(True)
    for k, (s, _) in enumerate(at):
        inside = F.bit_count(apart.bitwiseAND(F.lit(signed[k])))
        own = F.when(inside == 0, F.col("a.bit") == s).otherwise(inside == 1)  # one differing bit: only its wildcard matched
        here = here | ((F.col("a.segment") == k) & own & first)
        first = first & (inside > 1)
    return (a.join(b, (F.col("a.bit") == F.col("b.bit")) & (F.col("a.rest") == F.col("b.rest"))
                   & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(apart) <= max_bits) & here)
            .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text",
                 keep: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, fp)`` and the columns of ``keep``, checkpointed: texts are hashed once."""
    small_batches(docs.sparkSession)
    more = [c.alias(k) for k, c in (keep or {}).items()]
    return cut(docs.select(F.col(id_col).alias("doc_id"), *more, fingerprint_column(F.col(text_col), shingle).alias("fp")))


def classes(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint of ``(doc_id, fp)``: the smallest
    fingerprint reachable, and the smallest doc_id of all documents that have one of its class."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(distinct.select("fp"), max_bits))
    own = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", F.coalesce("root", "fp").alias("root"), "first_doc"))
    # only classes of several fingerprints need the second look
    several = own.filter("fp != root").select("root").distinct()
    low = cut(own.join(several, "root").groupBy("root").agg(F.min("first_doc").alias("low")))
    return cut(own.join(low, "root", "left").select("fp", "root", F.coalesce("low", "first_doc").alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link at ``max_bits`` or fewer differing bits; component_id is the smallest doc_id
    reachable (null only if no document of the class has an id). Null and empty texts and texts of
    white space alone have fingerprint zero and link like any other; repeated rows each return;
    an empty table gives an empty result; further columns are ignored.
    """
    prints = fingerprints(docs, shingle, id_col, text_col)
    found = classes(prints, max_bits).select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id (a null id comes
    last; ties go to the smallest hash of the whole row). Of repeated rows one stays. Texts without words,
    null ones too, form one class, with those of fingerprints near zero. An empty table gives an empty
    result."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    prints = fingerprints(docs, shingle, id_col, text_col, {"row_hash": own})
    found = classes(prints, max_bits).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash"))
    kept = cut(prints.join(found, "fp").groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.row_hash"))
    alike = prints.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n")).filter("n > 1")
    kept = cut(kept.alias("k").join(alike.alias("r"), F.col("k.doc_id").eqNullSafe(F.col("r.doc_id"))
                                    & (F.col("k.row_hash") == F.col("r.row_hash")), "left")
               .select("k.doc_id", "k.row_hash", F.col("r.n").isNotNull().alias("several")))
    rows = docs.select(as_row(docs).alias("row"), own.alias("h")).join(
        kept, F.col(f"row.{id_col}").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("row_hash")))
    single = rows.filter("not several").select("row")
    return single.unionByName(rows.filter("several").dropDuplicates(["doc_id", "row_hash"]).select("row")).select(*from_row(docs))
