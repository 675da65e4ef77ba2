"""Sampling, splits, ordering and batching (SPL-01..11).

Reference randomness (seeded library shuffles) cannot be replayed, so rows
are ordered by ``md5('<seed>|<id>')`` — stable in any engine. Sizes, strata,
disjointness and coverage follow the reference.

Exact splits never sort all rows in one task. The hash's first 4 hex digits
form 65,536 buckets that are *monotone* in the hash order:
1. count rows per (stratum, bucket) — map-side partial aggregation;
2. running offsets per stratum over that small table;
3. join the offsets back (≤ strata × 65,536 rows; broadcast when unstratified);
4. a bucket that lies wholly inside one split is labelled from its offset;
   only the few buckets that straddle a cut are ranked with a window
   (partitioned by bucket), then the two parts are unioned.
So the big data is scanned a few times but shuffled only for the boundary
buckets; no group, however hot, lands in one task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 4  # 16^4 = 65,536 hash buckets


def hash_key(id_cols, seed=42) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in ([id_cols] if isinstance(id_cols, str) else id_cols)]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def unit_interval(id_cols, seed=42) -> Column:
    """Deterministic u in [0, 1) from the first 32 bits of the md5 key."""
    h = hash_key(id_cols, seed)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _with_hash(df: DataFrame, id_cols, seed) -> DataFrame:
    return (df.withColumn("_h", hash_key(id_cols, seed))
            .withColumn("_b", F.conv(F.substring("_h", 1, BUCKET_HEX), 16, 10).cast("int")))


def _offsets(df: DataFrame, strata: list[str]) -> DataFrame:
    counts = df.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*strata) if strata else Window.partitionBy()).orderBy("_b")
    wn = Window.partitionBy(*strata) if strata else Window.partitionBy()
    return (counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_n", F.sum("_cnt").over(wn)))


def _join_offsets(df: DataFrame, offs: DataFrame, strata: list[str]) -> DataFrame:
    if not strata:
        # ≤ 65,536 rows by construction: safe to broadcast
        return df.join(F.broadcast(offs), "_b")
    cond = reduce(lambda a, b: a & b,
                  [df[s].eqNullSafe(offs[s]) for s in strata] + [df["_b"] == offs["_b"]])
    return df.join(offs, cond).drop(*[offs[s] for s in strata]).drop(offs["_b"])


def _label(pos: Column, cuts: list[Column], labels: list[str]) -> Column:
    out = F.lit(labels[-1])
    for c, lab in reversed(list(zip(cuts, labels[:-1]))):
        out = F.when(pos < c, F.lit(lab)).otherwise(out)
    return out


def assign_by_rank(df: DataFrame, id_cols, cuts_fn, labels: list[str], strata: list[str] | None = None,
                   seed=42, out_col: str = "split", tie_cols=None, offsets_hook=None) -> DataFrame:
    """Label rows by their exact 0-based position in hash order within each
    stratum. ``cuts_fn(n)`` → cumulative cut positions (Columns) for a stratum
    of size ``n``; rows before cut i get ``labels[i]``."""
    strata = strata or []
    tie_cols = tie_cols or ([id_cols] if isinstance(id_cols, str) else list(id_cols))
    d = _with_hash(df, id_cols, seed)
    offs = _offsets(d, strata)
    extra = []
    if offsets_hook is not None:
        before = set(offs.columns)
        offs = offsets_hook(offs)
        extra = [c for c in offs.columns if c not in before]
    j = _join_offsets(d, offs, strata)
    cuts = cuts_fn(F.col("_n"))
    lo, hi = F.col("_off"), F.col("_off") + F.col("_cnt")
    straddles = reduce(lambda a, b: a | b, [(lo < c) & (c < hi) for c in cuts])
    clean = j.where(~straddles).withColumn(out_col, _label(lo, cuts, labels))
    w = Window.partitionBy(*strata, "_b").orderBy("_h", *tie_cols)
    edge = (j.where(straddles).withColumn("_pos", lo + F.row_number().over(w) - 1)
            .withColumn(out_col, _label(F.col("_pos"), cuts, labels)).drop("_pos"))
    drop = ["_h", "_b", "_cnt", "_off", "_n"] + extra
    return clean.drop(*drop).unionByName(edge.drop(*drop))


def split_dataset(df: DataFrame, id_cols, train: float = 0.8, val: float = 0.1, test: float = 0.1,
                  stratify_by: str | None = None, seed=42) -> DataFrame:
    """SPL-01/02: exact 3-way split. n_train = floor(train·n); of the rest,
    validation = floor(rest·val/(val+test)). Stratified: the same per stratum
    (NULL is a stratum of its own)."""
    check_ratios(train, val, test)
    adj = val / (val + test)

    def cuts(n):
        n_train = F.floor(F.lit(float(train)) * n)
        n_val = F.floor((n - n_train) * F.lit(float(adj)))
        return [n_train, n_train + n_val]

    strata = [stratify_by] if stratify_by else []
    return assign_by_rank(df, id_cols, cuts, ["train", "validation", "test"], strata, seed)


def hash_split(df: DataFrame, id_cols, train: float = 0.8, val: float = 0.1, test: float = 0.1,
               seed=42, out_col: str = "split") -> DataFrame:
    """SPL-01 approximate mode: each row's seeded hash in [0, 1) against the
    cumulative ratios — one narrow projection, no counts and no shuffle;
    split sizes are right in expectation rather than exactly."""
    check_ratios(train, val, test)
    u = unit_interval(id_cols, seed)
    return df.withColumn(out_col, F.when(u < F.lit(float(train)), "train")
                         .when(u < F.lit(float(train + val)), "validation").otherwise("test"))


def check_ratios(train: float, val: float, test: float) -> None:
    """SPL-03."""
    if abs(train + val + test - 1.0) >= 1e-10:
        raise ValueError("Ratios must sum to 1")


def split_two_way(df: DataFrame, id_cols, train: float = 0.9, seed=42) -> DataFrame:
    """SPL-05: first int(n·train) rows of the shuffled order → train."""
    return assign_by_rank(df, id_cols, lambda n: [F.floor(F.lit(float(train)) * n)],
                          ["train", "validation"], None, seed)


def temporal_split(df: DataFrame, year_col: str = "year", threshold: int = 2020,
                   out_col: str = "split") -> DataFrame:
    """SPL-04: year < T train, = T validation, > T test; missing year = 0."""
    y = F.coalesce(F.col(year_col), F.lit(0))
    return df.withColumn(out_col, F.when(y < threshold, "train").when(y == threshold, "validation")
                         .otherwise("test"))


def shuffle(df: DataFrame, id_cols, seed=42) -> DataFrame:
    """SPL-06: total order by the seeded hash (range-partitioned sort)."""
    return df.orderBy(hash_key(id_cols, seed))


def global_rank(df: DataFrame, id_cols, seed=42, strata: list[str] | None = None,
                out_col: str = "rank") -> DataFrame:
    """0-based position of every row in seeded-hash order (per stratum): one
    shuffle by hash bucket (uniform, skew-free), window rank per bucket plus
    the bucket's offset."""
    strata = strata or []
    d = _with_hash(df, id_cols, seed)
    j = _join_offsets(d, _offsets(d, strata), strata)
    tie = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    w = Window.partitionBy(*strata, "_b").orderBy("_h", *tie)
    return (j.withColumn(out_col, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
            .drop("_h", "_b", "_cnt", "_off", "_n"))


def with_batch_id(df: DataFrame, id_cols, batch_size: int, seed=42) -> DataFrame:
    """SPL-11: fixed-size batches in seeded order: floor(rank / size)."""
    r = global_rank(df, id_cols, seed)
    return r.withColumn("batch_id", F.floor(F.col("rank") / batch_size).cast("bigint"))


def bucket_by_length(df: DataFrame, length: Column | str, id_cols, batch_size: int,
                     bucket_width: int = 256, salt_buckets: int = 64, seed=42) -> DataFrame:
    """SPL-10: batches of similar length. Length bucket = floor(len/width);
    each bucket is split into ``salt_buckets`` hash sub-groups so a hot length
    cannot land in one task; inside a sub-group rows are sorted by length and
    cut into batches of ``batch_size``."""
    ln = F.col(length) if isinstance(length, str) else length
    tie = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    d = (df.withColumn("_len", ln).withColumn("length_bucket", F.floor(F.col("_len") / bucket_width).cast("bigint"))
         .withColumn("salt", (F.conv(F.substring(hash_key(id_cols, seed), 1, 8), 16, 10).cast("bigint")
                              % salt_buckets).cast("int")))
    w = Window.partitionBy("length_bucket", "salt").orderBy("_len", *tie)
    return (d.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / batch_size).cast("bigint"))
            .drop("_len"))


def _budget_plan(budget: int):
    """For every length, longest first: where its rows go. A batch that begins with a row of
    some length takes ``budget // length`` rows (one at least), shorter ones too."""
    def run(parts):
        counts = [(int(a), int(b)) for p in parts for a, b in zip(p["_len"], p["_n"])]
        rows, room, batches = [], 0, 0
        for size, count in sorted(counts, reverse=True):
            carried = min(room, count)
            most = max(1, budget // max(1, size))
            begun = -(-(count - carried) // most)
            rows.append((size, carried, batches - 1, batches, most))
            room = begun * most - (count - carried) if begun else room - carried
            batches += begun
        yield pd.DataFrame(rows, columns=["_len", "_carried", "_open", "_first", "_most"])

    return run


def batch_by_budget(df: DataFrame, length: Column | str, id_cols, budget: int, seed=42) -> DataFrame:
    """SPL-10: batches of similar length whose padded size (rows times longest row) is ``budget`` at
    most, or a single longer row: rows go by falling length, equal lengths in seeded order, and every
    batch but the last is full. Null lengths count as 0.

    Ranks come from the histogram of lengths (a row per distinct length, which one task turns into a
    plan) and from counts by length and hash bucket, so rows of a hot length lie in many tasks."""
    ln = F.col(length) if isinstance(length, str) else length
    d = df.withColumn("_len", F.greatest(F.coalesce(ln.cast("long"), F.lit(0)), F.lit(0)))
    plan = (d.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).coalesce(1)
            .mapInPandas(_budget_plan(budget), "_len long, _carried long, _open long, _first long, _most long"))
    ranked = global_rank(d, id_cols, seed, ["_len"], "_rank").join(plan, "_len")
    batch = F.when(F.col("_rank") < F.col("_carried"), F.col("_open")).otherwise(F.col("_first") + F.floor((F.col("_rank") - F.col("_carried")) / F.col("_most")))
    return ranked.select(*df.columns, batch.cast("bigint").alias("batch_id"))


def mix(df: DataFrame, id_cols, category_col: str, shares: dict, seed=42) -> DataFrame:
    """SPL-07: keep floor(N·share_c) rows of each category c (seeded order),
    N = the largest total every category can fill = min_c floor(count_c/share_c),
    0 if a category of ``shares`` has no rows. Categories without a share are dropped."""
    d = df.where(F.col(category_col).isin(list(shares)))
    share = F.element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))]),
                         F.col(category_col))

    def quota(offs):
        # offsets table: one row per (category, bucket) — small; N over all categories
        every = Window.partitionBy()
        present = F.size(F.collect_set(category_col).over(every))
        n_fill = F.when(present == len(shares), F.min(F.floor(F.col("_n") / share)).over(every)).otherwise(0)
        return offs.withColumn("_quota", F.floor(n_fill * share))

    r = assign_by_rank(d, id_cols, lambda n: [F.col("_quota")], ["keep", "drop"], [category_col], seed,
                       out_col="_mix", offsets_hook=quota)
    return r.where(F.col("_mix") == "keep").drop("_mix")


def assign_variant(df: DataFrame, id_cols, weights: dict, seed=42, out_col: str = "variant") -> DataFrame:
    """SPL-08: weighted assignment by a hash in [0, 1) against cumulative weights."""
    u = unit_interval(id_cols, seed)
    items = list(weights.items())
    total = sum(w for _, w in items)
    out = F.lit(items[-1][0])
    acc = 0.0
    cum = []
    for name, w in items:
        acc += w / total
        cum.append((name, acc))
    for name, c in reversed(cum[:-1]):
        out = F.when(u < F.lit(c), F.lit(name)).otherwise(out)
    return df.withColumn(out_col, out)


def capture_sample(df: DataFrame, id_cols, percentage: float, seed=42) -> DataFrame:
    """SPL-09: repeatable capture of ``percentage`` % of rows (the reference
    captures 100 %)."""
    return df.where(unit_interval(id_cols, seed) < F.lit(percentage / 100.0))
