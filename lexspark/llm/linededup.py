"""Line deduplication by an exact set-similarity join.

A line is the set of its words (runs without ASCII white space, as written). Words are ordered by
rarity; a set's prefix holds so many of its rarest words that two sets of Jaccard ``similarity``
or more share a word there. Sets that meet on a prefix word pass a length filter, a positional
filter and a bitmap filter (all safe) before their Jaccard is verified on the whole sets. A line
goes if an earlier line, by (doc_id, line number), has the same set or a similar one, whether or
not that earlier line goes too.

Two rounds keep groups of near copies from being spelled out in pairs. In the first, every posting
meets only the earliest one of its word; nearly all members of a group are settled there. The
second pairs what is still unsettled with all earlier postings of its words. Only one earlier match
is needed to remove a line, so no list of all links is made; no decision depends on the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, cut, from_row, small_batches, written
from .ranges import Held, dealt, flat, ranges_for
from .words import bit_set, bits, mix, words_of

_BITS = 18
BUCKETS = 1 << _BITS  # of the rarity histogram: words that share a bucket count as equally rare
_ROW = 1024  # buckets to a row of it
PART_ROWS = 1 << 17  # lines a word may be on before its postings are dealt to several parts
RUN_ROWS = 1 << 16  # postings of one word that a task holds at once
SHIFTS = 2048  # a word's posting is compared with so many neighbours when its list is examined
_LAST = (1 << 63) - 1  # order of a null id
_LAST_ORDER = (1 << 32) - 1


def _line_sets(texts: pa.Array, rank: np.ndarray | None = None):
    """For each segment: row, number and size of every line with words, and the hashes of its
    distinct words, line by line; by ``rank`` of their buckets, if given, and the rest of the hash."""
    for row, number, line, words in words_of(texts):
        if not len(words):
            continue
        if rank is not None:  # one to one with the hash, like the hash itself
            words_by = (rank[(words & np.uint64(BUCKETS - 1)).astype(np.int64)] << np.uint64(64 - _BITS)) | (words >> np.uint64(_BITS))
        else:
            words_by = words
        key = (line.astype(np.uint64) << np.uint64(44)) | (words_by >> np.uint64(20))
        by = np.argsort(key) if line[-1] < 1 << 20 else np.lexsort((words_by, line))
        tied = words_by[by]
        if (np.diff(key[by]) == 0)[np.diff(tied) != 0].any():  # the key leaves out bits that matter here
            by = np.lexsort((words_by, line))
        line, words = line[by], words[by]
        new = np.concatenate(([True], (words[1:] != words[:-1]) | (line[1:] != line[:-1])))
        line, words = line[new], words[new]
        at, size = np.unique(line, return_counts=True)
        yield row[at], number[at], size, words


def _sums(size: np.ndarray, values: np.ndarray, how=np.add) -> np.ndarray:
    return how.reduceat(values, np.concatenate(([0], np.cumsum(size)[:-1]))) if len(size) else values[:0]


def _parities(size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's bitmap: for each of 128 numbers a word can have, whether an odd number of words has it."""
    bit = words >> np.uint64(57)
    flip = np.uint64(1) << (bit & np.uint64(63))
    none = np.uint64(0)
    return _sums(size, np.where(bit < 64, flip, none), np.bitwise_xor), _sums(size, np.where(bit < 64, none, flip), np.bitwise_xor)


def _key(size: np.ndarray, words: np.ndarray, seed: int) -> np.ndarray:
    return _sums(size, mix(words, seed)).astype(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every line with words; at the end, the task's histogram: rows of ``_ROW`` buckets,
    numbered in k1, with the lines on which words of each stand."""
    histogram = np.zeros(BUCKETS, np.int64)
    names = ["doc_order", "text_hash", "line_no", "k1", "k2", "counts"]
    for b in batches:
        for row, number, size, words in _line_sets(b.column("text")):
            histogram += np.bincount((words & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_order").take(at), b.column("text_hash").take(at), pa.array(number), pa.array(_key(size, words, 1)),
                 pa.array(_key(size, words, 2)), pa.nulls(len(row), pa.list_(pa.int64()))], names=names)
    n = BUCKETS // _ROW
    none = pa.nulls(n, pa.int64())
    counts = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * _ROW, pa.int32()), pa.array(histogram))
    yield pa.RecordBatch.from_arrays([none, none, none, pa.array(np.arange(n)), none, counts], names=names)


def _alpha(a, b, t: Fraction):
    """The overlap that sets of a and b words need for Jaccard t."""
    return -((a + b) * -t.numerator // (t.numerator + t.denominator))


def _passes(n1, p1, s1, z1, n2, p2, s2, z2, t: Fraction):
    """Length, positional and bitmap filter for postings of one word at positions p1 and p2, with bitmaps (s1, z1) and (s2, z2)."""
    need = _alpha(n1, n2, t)
    return ((np.minimum(n1, n2) * t.denominator >= np.maximum(n1, n2) * t.numerator)
            & (np.minimum(n1 - p1, n2 - p2) >= need) & (np.bitwise_count(s1 ^ s2).astype(np.int64) + np.bitwise_count(z1 ^ z2) <= n1 + n2 - 2 * need))


def _postings(counts: np.ndarray, t: Fraction, shift: int, ranges: int):
    """The prefix words of every set that a different set can be similar to.

    slot: word (32 bits of its hash) and order of the line's document (its id without ``shift``
    bits); a word on more than PART_ROWS lines is dealt to several slots by the set, and then
    ``dealt`` has the word itself, else ``_ALONE``. Postings of a slot's word are of one range.
    """
    rank = np.empty(BUCKETS, np.uint64)
    rank[np.lexsort((np.arange(BUCKETS), counts))] = np.arange(BUCKETS, dtype=np.uint64)
    parts = counts // PART_ROWS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(_POSTING)

        def out() -> pa.RecordBatch:
            columns = held.take()
            return dealt(columns["slot"] >> 32, columns, ranges)

        for b in batches:
            order = np.clip(b.column("doc_order").to_numpy() >> shift, 0, _LAST_ORDER)
            for row, _, size, words in _line_sets(b.column("text"), rank):
                first = np.cumsum(size) - size
                sig = _parities(size, words)
                cls = _key(size, words, 1)
                prefix = size - -(size * -t.numerator // t.denominator) + 1
                prefix[size * t.denominator < (size + 1) * t.numerator] = 0
                line = np.repeat(np.arange(len(size)), prefix)
                pos = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                word = words[first[line] + pos]
                deal = parts[(word & np.uint64(BUCKETS - 1)).astype(np.int64)]
                word = (word >> np.uint64(16)).astype(np.uint32).view(np.int32).astype(np.int64)
                own = np.where(deal > 1, (word + 1 + cls[line] % deal).astype(np.int32), word)
                if held.add((own << 32) | order[row[line]], cls[line], *(x[line].view(np.int64) for x in sig), (size[line] << 32) | pos, np.where(deal > 1, word, _ALONE)):
                    yield out()
        if held.rows:
            yield out()

    return run


_POSTING = ["slot", "cls", "sig", "sig2", "at", "dealt"]
_ALONE = 1 << 40  # no word has that number
_NOTHING = pa.RecordBatch.from_pydict(
    {c: pa.array([], pa.bool_() if c == "more" else pa.int64()) for c in ("word", "ord", "cls", "sig", "sig2", "n", "pos", "head", "more")})


def _examine(t: Fraction):
    """Of a range's postings, by word and order, those that pass with their list's first (``head``) or
    may pass with another one of the list (``more``)."""
    def part(x: pa.Table, first: list | None, whole: bool) -> tuple[pa.RecordBatch, list]:
        slot, cls, sig, sig2, at = (x.column(c).to_numpy() for c in ("slot", "cls", "sig", "sig2", "at"))
        spread = x.column("dealt").combine_chunks()
        dealt = spread.is_valid().to_numpy(zero_copy_only=False)
        word = np.where(dealt, spread.fill_null(0).to_numpy(), slot >> 32)
        order = slot & 0xFFFFFFFF
        new = np.concatenate(([True], (slot[1:] >> 32) != (slot[:-1] >> 32)))
        run = np.cumsum(new) - 1
        keep = dealt | ~(new & np.concatenate((new[1:], [True])))  # a word alone meets nothing
        if first is not None:
            keep |= run == 0
        if not whole:
            keep |= run == run[-1]
        if not keep.any():
            return _NOTHING, []
        word, cls, sig, sig2, at, dealt, order, run, new = (v[keep] for v in (word, cls, sig, sig2, at, dealt, order, run, new))
        run = np.cumsum(new) - 1
        by = np.lexsort((np.arange(len(cls)), cls, run))  # copies of a set: its first posting stays
        again = np.zeros(len(cls), bool)
        again[by[1:]] = (cls[by][1:] == cls[by][:-1]) & (run[by][1:] == run[by][:-1])
        if again.any():
            keep = ~again
            word, cls, sig, sig2, at, dealt, order, run, new = (v[keep] for v in (word, cls, sig, sig2, at, dealt, order, run, new))
        n, pos, sig, sig2 = at >> 32, at & 0xFFFFFFFF, sig.view(np.uint64), sig2.view(np.uint64)
        head = np.nonzero(new)[0][run]
        heads = [v[head] for v in (cls, n, pos, sig, sig2)]
        if first is not None:  # the list goes on from an earlier part
            heads = [np.where(run == 0, f, v) for f, v in zip(first, heads)]
        hc, *rest = heads
        found = _passes(n, pos, sig, sig2, *rest, t) & (cls != hc)
        length = np.bincount(run)
        more = dealt.copy()
        if not whole:
            more |= run == run[-1]
        if first is not None:
            more |= run == 0
        more |= (length > SHIFTS)[run]
        i = np.flatnonzero(~new & ~(length > SHIFTS)[run])  # rows after their list's first, to be compared with s rows on
        left = (np.cumsum(length) - 1)[run] - np.arange(len(run))
        s = 0
        while True:
            s += 1
            i = i[left[i] >= s]
            if not len(i):
                break
            ok = i[_passes(*(v[i + s] for v in (n, pos, sig, sig2)), *(v[i] for v in (n, pos, sig, sig2)), t)]
            more[ok] = more[ok + s] = True
        keep = found | more
        return pa.RecordBatch.from_arrays(
            [pa.array(word[keep]), pa.array(order[keep]), pa.array(cls[keep]), pa.array(sig[keep].view(np.int64)),
             pa.array(sig2[keep].view(np.int64)), pa.array(n[keep]), pa.array(pos[keep]), pa.array(hc[keep], mask=~found[keep]), pa.array(more[keep])],
            names=list(_NOTHING.schema.names)), [v[-1] for v in heads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, None  # rows at hand; the first posting of the list under way, if some of it went before
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < RUN_ROWS:
                continue
            x = pa.Table.from_batches(held).combine_chunks()
            list_ = x.column("slot").to_numpy() >> 32
            end = int(np.searchsorted(list_, list_[-1]))
            if end:
                yield part(x.slice(0, end), first, True)[0]
                x, first = x.slice(end), None
            if x.num_rows >= RUN_ROWS:
                out, first = part(x, first, False)
                yield out
                x = x.slice(x.num_rows)
            held, size = x.to_batches(), x.num_rows
        if size:
            yield part(pa.Table.from_batches(held).combine_chunks(), first, True)[0]

    def examine(rows: pa.Table) -> pa.Table:
        columns = {c: flat(rows, c) for c in _POSTING}
        order = np.argsort(columns["slot"], kind="stable")
        columns = {c: x[order] for c, x in columns.items()}
        alone = columns["dealt"] == _ALONE
        postings = pa.table([pa.array(x, mask=alone if c == "dealt" else None) for c, x in columns.items()], names=_POSTING)
        return pa.Table.from_batches(run(iter(postings.to_batches(max_chunksize=RUN_ROWS))), _NOTHING.schema)

    return examine


def _word_sets(wanted: np.ndarray):
    """Place, key and word hashes of the lines whose bit is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, number, size, words in _line_sets(b.column("text")):
                cls = _key(size, words, 1)
                ok = bit_set(wanted, cls)
                words, ends = words[np.repeat(ok, size)], np.concatenate(([0], np.cumsum(size[ok])))
                at = pa.array(row[ok])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_order").take(at), b.column("text_hash").take(at), pa.array(number[ok]), pa.array(cls[ok]),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.view(np.int64)))],
                    names=["doc_order", "text_hash", "line_no", "cls", "words"])

    return run


def _sql_passes(a: str, b: str, t: Fraction) -> Column:
    """``_passes`` for rows a and b of a join."""
    n1, n2, p1, p2 = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    total = n1 + n2
    need = F.ceil(total * t.numerator / F.lit(t.numerator + t.denominator) - F.lit(1e-9)).cast("long")
    return ((F.least(n1, n2) * t.denominator >= F.greatest(n1, n2) * t.numerator) & (F.least(n1 - p1, n2 - p2) >= need)
            & (sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in ("sig", "sig2")) <= total - 2 * need))


def _similar(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The later set ``cls`` of every pair whose Jaccard is verified on whole sets."""
    a = sets.select(F.col("cls").alias("a"), F.col("first").alias("fa"), F.col("words").alias("wa"))
    b = sets.select(F.col("cls").alias("b"), F.col("first").alias("fb"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    verified = pairs.join(a, "a").join(b, "b").filter(both * (t.numerator + t.denominator) >= (F.size("wa") + F.size("wb")) * t.numerator)
    return verified.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("cls")).distinct()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_order"),
                       F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def duplicate_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every line with words: doc_id, text_hash, line_no (from 0), first_doc_id and
    first_line_no (where its set of words stands first), removed.

    Ids are whole numbers; a null id comes last. Rows alike in id and text count as one document:
    their lines are listed once and aren't later matches of each other; rows that share an id alone
    are ordered by a hash of the text. Null and empty texts and lines of white space have no rows;
    an empty table gives none. Further columns are ignored.
    """
    t = Fraction(str(similarity))
    small_batches(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    read = written(source.mapInArrow(_lines, "doc_order long, text_hash long, line_no long, k1 long, k2 long, counts array<long>"), "lines")
    sums = (read.filter("counts is not null").select("k1", F.posexplode("counts").alias("at", "n")).filter("n > 0")
            .groupBy((F.col("k1") * _ROW + F.col("at")).alias("bucket")).agg(F.sum("n").alias("n")).toArrow())  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    lines = read.filter("counts is null").drop("counts")
    place = F.struct("doc_order", "text_hash", "line_no")
    classes = written(lines.groupBy("k1", "k2").agg(F.min(place).alias("first")), "classes")

    top, n = lines.agg(F.coalesce(F.max(F.when(F.col("doc_order") < _LAST, F.col("doc_order"))), F.lit(0)), F.count("*")).first()
    ranges = ranges_for(int(n + counts.sum() * (1 - t)))  # no set has more postings than this share of its words, and one
    shift = max(0, int(top).bit_length() - 32)
    postings = source.mapInArrow(_postings(counts, t, shift, ranges), "range long, " + ", ".join(f"{c} array<long>" for c in _POSTING))
    met = cut(postings.groupBy("range").applyInArrow(_examine(t), "word long, ord long, cls long, sig long, sig2 long, n long, pos long, head long, more boolean"))
    either = met.select("cls").unionByName(met.filter("head is not null").select(F.col("head").alias("cls"))).distinct()
    sets = written(source.mapInArrow(_word_sets(bits(either)), "doc_order long, text_hash long, line_no long, cls long, words array<long>")
                   .groupBy("cls").agg(F.first("words").alias("words"), F.min(place).alias("first")), "sets")

    def ordered(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    settled = cut(_similar(met.filter("head is not null").select(*ordered(F.col("cls"), F.col("head"))).distinct(), sets, t))
    pool = met.filter("more")
    open_ = pool.join(settled, "cls", "left_anti")
    rest = (open_.alias("u").join(pool.alias("l"), (F.col("u.word") == F.col("l.word")) & (F.col("l.ord") <= F.col("u.ord"))
                                  & (F.col("u.cls") != F.col("l.cls")) & _sql_passes("u", "l", t))
            .select(*ordered(F.col("u.cls"), F.col("l.cls"))).distinct())
    gone = cut(settled.unionByName(_similar(rest, sets, t)).distinct()).withColumn("similar", F.lit(True))

    own = written(classes.join(gone.withColumnRenamed("cls", "k1"), "k1", "left").select("k1", "k2", "first", "similar"), "removals")
    unknown = F.lit(_LAST)
    return (lines.distinct().join(own, ["k1", "k2"])
            .select(F.nullif("doc_order", unknown).alias("doc_id"), "text_hash", "line_no",
                    F.nullif("first.doc_order", unknown).alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"),
                    (F.col("similar").isNotNull() | (place != F.col("first"))).alias("removed")))


def drop_duplicate_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``duplicate_lines`` removes; a document all of whose lines
    with words go is dropped, one without such lines stays as it is. Kept lines, blank ones too,
    are unchanged; ``n_chars``, where there is one, follows the new text. Null and empty texts stay
    as they are; rows alike in id and text count as one document, so both of two such rows stay. An
    empty table gives an empty result."""
    found = duplicate_lines(docs, similarity, id_col, text_col)
    by_doc = (found.groupBy(F.coalesce("doc_id", F.lit(_LAST)).alias("_o"), F.col("text_hash").alias("_h"))
              .agg(F.collect_list(F.when(F.col("removed"), F.col("line_no"))).alias("_gone"), F.count("*").alias("_n"))
              .filter("size(_gone) > 0"))

    @F.pandas_udf("string")
    def without(text, gone):
        out = []
        for x, g in zip(text, gone):
            if g is not None and x is not None:
                g = set(map(int, g))
                x = "\n".join(line for k, line in enumerate(x.split("\n")) if k not in g)
            out.append(x)
        return type(text)(out, dtype=object)

    rows = docs.select(as_row(docs).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_o"), F.xxhash64(text_col).alias("_h"))
    kept = rows.join(by_doc, ["_o", "_h"], "left").filter("_n is null or size(_gone) < _n")
    text = F.col(f"row.{text_col}")
    kept = kept.select("row", F.when(F.col("_gone").isNull(), text).otherwise(without(text, F.col("_gone"))).alias("text"))
    changed = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*from_row(docs, **changed))
