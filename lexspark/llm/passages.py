"""Substring deduplication: MinHash banding of content-defined paragraphs.

A passage can be copied into the middle of another line, so paragraphs are cut by content: before a
word whose hash, taken with the next word's, is the smallest within ``REACH`` words on either side.
A copy is cut alike wherever it stands, but for its rims. Paragraphs are sets of five-word shingles,
long enough that one with a word changed is still similar. Their MinHash signature is cut into bands;
three rows of a band, and eight bands, find a pair of Jaccard 0.8 with probability 0.997 and copies
always. Colliding paragraphs are verified by exact Jaccard.
Similar paragraphs form components; in each, the first occurrence stays and the others go.

Words copied exactly are found word by word besides, so that neither the rims of a passage nor one
without a whole paragraph is left: of every ``min_words`` words the five with the smallest hash are
looked for in other documents first, and then the words themselves (``repeated_runs``). Runs that
follow each other in a document and in its source are joined over the changed words between them, up
to the same dissimilarity in edits (``_joined``).

A first round verifies every paragraph of a bucket against one of them, the second against the one
with the most links so far, the original of a family of changed copies, a third against the one with
the most links outside the component that has the bucket's least root, and the last pairs all
paragraphs of a bucket that are still in different components: groups of near copies aren't spelled out in pairs, and only
links within one component are left out, which change no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, written
from .components import components
from .ranges import Held, dealt, flat, ranges_for
from .words import bit_set, bits, mix, words_of

SHINGLE = 5
REACH = 25  # paragraphs have 26 words at least, but at a text's ends, and 51 on average
BANDS, ROWS = 8, 3
STARS = 2  # further rounds
PARITIES = 4  # 64-bit bitmaps of a set
RUN_ROWS = 1 << 16  # rows of one bucket that a task holds at once
_FACTORS = np.random.default_rng(23).integers(1, 1 << 62, BANDS * ROWS + SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = (1 << 63) - 1  # order of a null id
_MOST = np.iinfo(np.uint64).max


def _least(x: np.ndarray, length: int) -> np.ndarray:
    """The smallest of ``length`` places from each on; doubled spans take few passes."""
    span = 1
    while 2 * span <= length:
        x = np.minimum(x[:len(x) - span], x[span:])
        span *= 2
    rest = length - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def _grams(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, also across texts."""
    n = max(0, len(h) - length + 1)
    return mix(sum((h[j:j + n] * _FACTORS[BANDS * ROWS + j] for j in range(length)), np.zeros(n, np.uint64)), 13)


def _paragraphs(texts: pa.Array):
    """Of all paragraphs of SHINGLE words or more: row, number in the text, first word, words, key;
    and the shingles, paragraph by paragraph, with their numbers."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for row, _, line, words in words_of(texts):
        rows.append(row[line])
        hashes.append(words)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    n = len(h)
    pair = h * _FACTORS[0]
    pair[:-1] += np.where(row[1:] == row[:-1], h[1:], np.uint64(0)) * _FACTORS[1]
    pair = mix(pair, 5)
    lead = np.concatenate((np.zeros(min(1, n), np.int64), np.cumsum(row[1:] != row[:-1])))  # texts before
    place = np.arange(n) + REACH * (lead + 1)  # REACH places apart, texts don't meet
    padded = np.full(n + REACH * (int(lead[-1]) + 2 if n else 2), _MOST)
    padded[place] = pair
    least = _least(padded, REACH)
    begin = (pair < least[place - REACH]) & (pair <= least[place + 1])
    if n:
        begin[0] = True
        begin[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, n))
    text_at = at[np.searchsorted(row[at], row[at])] if n else at  # where the paragraph's text begins
    number = np.arange(len(at)) - np.searchsorted(row[at], row[at]) if n else at
    key = mix(h + (np.arange(n) - np.repeat(at, size)).astype(np.uint64) * _FACTORS[2], 9)
    key = np.add.reduceat(key, at) if n else key
    long_ = size >= SHINGLE
    each = np.where(long_, size - SHINGLE + 1, 0)
    of = np.repeat(np.arange(len(at)), each)
    place = np.repeat(at, each) + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    return row[at][long_], number[long_], (at - text_at)[long_], size[long_], key[long_].view(np.int64), each[long_], _grams(h, SHINGLE)[place]


def _in_ranges(made, names: list[str], ranges: int):
    """What ``made`` makes of each batch, columns of ``names``, dealt by ranges of the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(names)
        for b in batches:
            for columns in made(b):
                if held.add(*columns):
                    part = held.take()
                    yield dealt(part[names[0]].view(np.uint64), part, ranges)
        if held.rows:
            part = held.take()
            yield dealt(part[names[0]].view(np.uint64), part, ranges)

    return run


def _lists(names: list[str]) -> str:
    return "range long, " + ", ".join(f"{c} array<{'int' if c == 'start_word' else 'long'}>" for c in names)


_BANDED = ["bucket", "cls", "n"]


def _banded(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, cls, n): a row for each band of each distinct paragraph of a batch. The lowest bits
    of a bucket are its band."""
    _, _, _, _, key, each, shingle = _paragraphs(b.column("text"))
    if not len(key):
        return
    key, first, n = np.unique(key, return_index=True, return_counts=True)
    start = (np.cumsum(each) - each)
    least = [np.minimum.reduceat(shingle * f ^ (shingle >> np.uint64(31)), start)[first] for f in _FACTORS[:BANDS * ROWS]]
    for band in range(BANDS):
        bucket = np.zeros(len(key), np.uint64)
        for r in range(ROWS):
            bucket = mix(bucket + least[band * ROWS + r], 17 + band)
        bucket = (bucket & ~np.uint64(7)) | np.uint64(band)
        yield bucket.view(np.int64), key, n


_MET = pa.schema([("bucket", pa.int64()), ("cls", pa.int64()), ("head", pa.int64()), ("repeated", pa.bool_()), ("crowd", pa.bool_())])


def _collide_range(rows: pa.Table) -> pa.Table:
    """``_collide`` for the rows of one range."""
    x = {c: flat(rows, c) for c in _BANDED}
    order = np.lexsort((x["cls"], x["bucket"]))
    table = pa.table([v[order] for v in x.values()], names=_BANDED)
    return pa.Table.from_batches([b.cast(_MET) for b in _collide(iter(table.to_batches(max_chunksize=RUN_ROWS)))], _MET)


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket and paragraph: paragraphs that repeat (from the first band), and
    for buckets of several paragraphs each one but the first, with the first (``head``). ``crowd``:
    there are more than two, so a paragraph may collide with yet another."""
    def out(bucket, cls, n, head, other):
        """other: whether a paragraph stands in a bucket of at least three."""
        new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (cls[1:] != cls[:-1])))
        total = np.add.reduceat(n, np.flatnonzero(new))
        bucket, cls = bucket[new], cls[new]
        begin = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        run = np.cumsum(begin) - 1
        heads = cls[np.flatnonzero(begin)][run]
        if head is not None:
            heads = np.where(run == 0, head, heads)
        crowd = (np.bincount(run)[run] > 2) | (other & ((run == 0) | (run == run[-1])))
        mates = cls != heads
        keep = mates | crowd | ((total > 1) & (bucket & 7 == 0))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[keep]), pa.array(cls[keep]), pa.array(heads[keep], mask=~mates[keep]), pa.array(((total > 1) & (bucket & 7 == 0))[keep]),
             pa.array(crowd[keep])], names=["bucket", "cls", "head", "repeated", "crowd"]), heads[-1]

    held, head = None, None
    for b in batches:
        x = [b.column(c).to_numpy() for c in ("bucket", "cls", "n")]
        held = x if held is None else [np.concatenate(p) for p in zip(held, x)]
        if len(held[0]) < RUN_ROWS:
            continue
        end = int(np.searchsorted(held[0], held[0][-1]))
        if end:
            yield out(*(v[:end] for v in held), head, head is not None)[0]
            held, head = [v[end:] for v in held], None
        if len(held[0]) >= RUN_ROWS:  # one bucket: only its last paragraph may go on
            last = int(np.searchsorted(held[1], held[1][-1]))
            if last:
                batch, head = out(*(v[:last] for v in held), head, True)
                yield batch
                held = [v[last:] for v in held]
            else:
                held = [v[:1] if i < 2 else v.sum(keepdims=True) for i, v in enumerate(held)]
    if held is not None and len(held[0]):
        yield out(*held, head, head is not None)[0]


def _occurrences(wanted: np.ndarray, paired: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, number, first, size, key, each, shingle = _paragraphs(b.column("text"))
            ok, pairs = bit_set(wanted, key), bit_set(paired, key)
            shown = np.where(pairs, each, 0)[ok]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(shown))), pa.int32()),
                                             pa.array(shingle[np.repeat(ok & pairs, each)].view(np.int64)))
            at = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_order").take(at), b.column("text_hash").take(at), pa.array(number[ok]), pa.array(first[ok]), pa.array(size[ok]),
                 pa.array(key[ok]), lists], names=["doc_order", "text_hash", "number", "start_word", "n_words", "cls", "shingles"])

    return run


def _windows(texts: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Row, first word and anchor of all runs of ``length`` words, where they begin among all words,
    and the words' hashes: the anchor is the smallest hash of SHINGLE words in the run, so equal runs
    have the same."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for row, _, line, words in words_of(texts):
        rows.append(row[line])
        hashes.append(words)
    row, h = np.concatenate(rows), np.concatenate(hashes)
    least = min(SHINGLE, length)
    gram = _grams(h, least)
    n = max(0, len(h) - length + 1)
    at = np.flatnonzero(row[:n] == row[len(row) - n:])
    anchor = _least(gram, length - least + 1)[at] if n else gram[at]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    first = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    return row[at], first[at], anchor.view(np.int64), at, h


def _wholes(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs that begin at ``at``."""
    whole = np.zeros(len(at), np.uint64)
    for j in range(length):
        whole = whole * _FACTORS[0] + h[at + j]
    return mix(whole, 21).view(np.int64)


def _anchors(length: int):
    def made(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        row, _, anchor, _, _ = _windows(b.column("text"), length)
        new = np.ones(len(row), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        yield anchor[new], b.column("doc").to_numpy()[row[new]]

    return made


def _several(rows: pa.Table) -> pa.Table:
    """Anchors of a range that stand in several documents."""
    cls, doc = flat(rows, "cls"), flat(rows, "doc")
    order = np.lexsort((doc, cls))
    cls, doc = cls[order], doc[order]
    apart = (cls[1:] == cls[:-1]) & (doc[1:] != doc[:-1])
    return pa.table([np.unique(cls[1:][apart])], names=["cls"])


_RUN = ["run", "doc_order", "text_hash", "start_word"]


def _firsts(rows: pa.Table) -> pa.Table:
    """The first place of every run of a range that stands in several documents."""
    run, doc, text, word = (flat(rows, c) for c in _RUN)
    order = np.lexsort((word, text, doc, run))
    run, doc, text, word = run[order], doc[order], text[order], word[order]
    new = np.concatenate((np.ones(min(1, len(run)), bool), run[1:] != run[:-1]))
    other = ~new
    other[1:] &= (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)[np.bincount(group, other, minlength=int(new.sum())) > 0]
    return pa.table([run[at], doc[at], text[at], word[at].astype(np.int64)], names=_RUN)


def _anchored(wanted: np.ndarray, length: int, shared: np.ndarray):
    """The runs whose anchor's bit is set, and their own in ``shared``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, first, anchor, at, h = _windows(b.column("text"), length)
            ok = np.flatnonzero(bit_set(wanted, anchor))
            whole = _wholes(h, at[ok], length)
            met = bit_set(shared, whole)
            ok, whole = ok[met], whole[met]
            at = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays([b.column("doc_order").take(at), b.column("text_hash").take(at), pa.array(first[ok]), pa.array(whole)],
                                             names=["doc_order", "text_hash", "start_word", "run"])

    return run


def _run_places(wanted: np.ndarray, length: int):
    def made(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        row, first, anchor, at, h = _windows(b.column("text"), length)
        ok = bit_set(wanted, anchor)
        yield _wholes(h, at[ok], length), b.column("doc_order").to_numpy()[row[ok]], b.column("text_hash").to_numpy()[row[ok]], first[ok].astype(np.int32)

    return made


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size(F.array_union("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").filter(both * t.denominator >= either * t.numerator).select("a", "b")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_order"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))


def _bytes(source: DataFrame) -> int:
    return source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def repeated_passages(docs: DataFrame, similarity: float = 0.8, min_words: int = 15, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``repeated_paragraphs``, ``repeated_runs`` and ``_joined``, which may overlap: a word
    goes if a row that has it is ``removed``. Nulls, empty texts, repeated rows, an empty table and
    further columns: as in ``repeated_paragraphs``."""
    runs = _runs(docs, min_words, id_col, text_col)  # first: it leaves little on disk
    paragraphs = repeated_paragraphs(docs, similarity, min_words, id_col, text_col)
    return paragraphs.unionByName(_shown(runs)).unionByName(_shown(_joined(runs, similarity)))


def repeated_runs(docs: DataFrame, min_words: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every run of ``min_words`` words or more that stands alike in another document,
    with the columns of ``repeated_paragraphs``; the passage is the run. All such words have a row.
    Where the first occurrences of a run's parts lie elsewhere, the parts have rows of their own,
    which overlap. Words and runs are known by 64-bit hashes. Nulls, empty texts, repeated rows, an
    empty table and further columns: as in ``repeated_paragraphs``."""
    return _shown(_runs(docs, min_words, id_col, text_col))


def _runs(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    ranges = ranges_for(_bytes(source) // 12)  # an anchor and a run for each few words
    anchors = source.select(F.xxhash64("doc_order", "text_hash").alias("doc"), "text").mapInArrow(_in_ranges(_anchors(min_words), ["cls", "doc"], ranges), _lists(["cls", "doc"]))
    wanted, schema = bits(cut(anchors.groupBy("range").applyInArrow(_several, "cls long"))), "doc_order long, text_hash long, start_word long, run long"
    places = source.mapInArrow(_in_ranges(_run_places(wanted, min_words), _RUN, ranges), _lists(_RUN))
    firsts = written(places.groupBy("range").applyInArrow(_firsts, "run long, doc_order long, text_hash long, start_word long")
                     .select("run", F.struct("doc_order", "text_hash", "start_word").alias("first")), "firsts")
    runs = source.mapInArrow(_anchored(wanted, min_words, bits(firsts.select(F.col("run").alias("cls")))), schema)
    shift = F.col("start_word") - F.col("first.start_word")
    own = [*_PAIR, "shift"]
    met = (runs.join(firsts, "run").select("doc_order", "text_hash", "start_word", F.col("first.doc_order").alias("first_order"),
                                           F.col("first.text_hash").alias("first_hash"), shift.alias("shift")))
    length = F.max("start_word") - F.min("start_word") + F.lit(min_words)
    return written(met.withColumn("island", F.col("start_word") - F.dense_rank().over(Window.partitionBy(*own).orderBy("start_word")))
                   .groupBy(*own, "island").agg(F.min("start_word").alias("start_word"), length.alias("n_words")), "runs")


_PAIR = ["doc_order", "text_hash", "first_order", "first_hash"]


def _joined(runs: DataFrame, similarity: float) -> DataFrame:
    """Runs of one document and its source that follow each other in both, with what stands between
    them, where the words from the first to the last differ from the source's in at most
    1 - ``similarity`` of them: the edit distance is at most the longer gap, as the runs are alike."""
    t = Fraction(str(similarity))
    follow = Window.partitionBy(*_PAIR).orderBy("start_word", "shift")
    before = F.lag(F.struct("start_word", "n_words", "shift")).over(follow)
    own = F.col("start_word") - F.col("p.start_word") - F.col("p.n_words")  # words between them here
    source = own - F.col("shift") + F.col("p.shift")  # and there
    gap = F.greatest(own, source)
    close = gap * t.denominator <= (F.col("p.n_words") + F.col("n_words") + gap) * (t.denominator - t.numerator)
    found = runs.withColumn("p", before).filter(F.col("p").isNotNull() & (own >= 0) & (source >= 0) & close)
    return found.select(*_PAIR, F.col("p.shift").alias("shift"), F.col("p.start_word").alias("start_word"),
                        (F.col("start_word") + F.col("n_words") - F.col("p.start_word")).alias("n_words"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.nullif("doc_order", F.lit(_LAST)).alias("doc_id"), "text_hash", "start_word", "n_words", F.col("start_word").alias("passage_start"),
                       F.col("n_words").alias("passage_words"), F.nullif("first_order", F.lit(_LAST)).alias("first_doc_id"),
                       (F.col("start_word") - F.col("shift")).alias("first_start_word"),
                       ((F.col("doc_order") != F.col("first_order")) | (F.col("text_hash") != F.col("first_hash")) | (F.col("shift") != 0)).alias("removed"))


def repeated_paragraphs(docs: DataFrame, similarity: float = 0.8, min_words: int = 15, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """A row for every paragraph that stands, alike or similar, in another document as part of a
    passage of ``min_words`` words or more: doc_id, text_hash, start_word (from 0), n_words,
    passage_start and passage_words (of the run of such paragraphs), first_doc_id and
    first_start_word (the component's first occurrence), removed (it is not the first).

    Words are runs without ASCII white space; paragraphs of fewer than five are no copies of
    anything. Rows alike in id and text count as one document; a null id comes last; null and
    empty texts have no paragraphs; an empty table gives an empty result; further columns are
    ignored. Ids are whole numbers.
    """
    t = Fraction(str(similarity))
    small_batches(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    ranges = ranges_for(_bytes(source) // 12)  # no more rows than that: eight bands for a paragraph of 51 words
    met = cut(source.select("text").mapInArrow(_in_ranges(_banded, _BANDED, ranges), _lists(_BANDED))
              .groupBy("range").applyInArrow(_collide_range, "bucket long, cls long, head long, repeated boolean, crowd boolean"))
    star = cut(met.filter("head is not null").select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct())
    paired = cut(star.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(met.filter("crowd").select("cls")).distinct())
    again = cut(met.filter("repeated").select("cls").distinct())
    found = cut(source.mapInArrow(_occurrences(bits(again.unionByName(paired).distinct()), bits(paired)),
                                  "doc_order long, text_hash long, number long, start_word long, n_words long, cls long, shingles array<long>"))
    sets = found.filter("size(shingles) > 0").groupBy("cls").agg(F.array_distinct(F.first("shingles")).alias("shingles"))
    sig = [f"sig{w}" for w in range(PARITIES)]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def parity(w: int) -> Column:
        """Bit x % 64 of the shingles x whose next two bits are w."""
        return F.aggregate("shingles", zero, lambda a, x: a.bitwiseXOR(
            F.when(F.shiftright(x, 6).bitwiseAND(PARITIES - 1) == w, F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))).otherwise(zero)))

    sets = cut(sets.select("cls", "shingles", F.size("shingles").alias("n"), *[parity(w).alias(c) for w, c in enumerate(sig)]))

    links = cut(_verified(star, sets, t))
    crowd = cut(met.filter("crowd").select("bucket", "cls").distinct().join(sets.select("cls", "n", *sig), "cls"))

    def like(u: str, c: str) -> Column:
        """Sets of Jaccard t or more are of like size and differ in few shingles, so in few bits of their parities."""
        both = F.col(f"{u}.n") + F.col(f"{c}.n")
        differ = both - 2 * F.ceil(both * t.numerator / F.lit(t.numerator + t.denominator) - F.lit(1e-9))
        return ((F.least(f"{u}.n", f"{c}.n") * t.denominator >= F.greatest(f"{u}.n", f"{c}.n") * t.numerator)
                & (sum(F.bit_count(F.col(f"{u}.{x}").bitwiseXOR(F.col(f"{c}.{x}"))) for x in sig) <= differ))

    def labelled() -> DataFrame:
        """The buckets that hold several components (root), with the least of them (low)."""
        roots = components(links).withColumnRenamed("node", "cls")
        own = crowd.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        several = own.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket", "low")
        return cut(own.join(several, "bucket"))

    def pairs(u: DataFrame, c: DataFrame, apart: Column) -> DataFrame:
        met_ = u.alias("u").join(c.alias("c"), (F.col("u.bucket") == F.col("c.bucket")) & apart & like("u", "c"))
        return met_.select(F.least("u.cls", "c.cls").alias("a"), F.greatest("u.cls", "c.cls").alias("b")).distinct()

    for k in range(STARS):
        several = labelled()
        degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg((-F.count("*")).alias("degree"))
        outside = several if k == 0 else several.filter("root != low")
        heads = cut(outside.join(degree, "cls", "left").groupBy("bucket").agg(F.min(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "cls", "n", *sig, "root"))
                                                                               .alias("h")).select("bucket", "h.*"))
        links = cut(links.unionByName(_verified(pairs(several, heads, F.col("u.root") != F.col("c.root")), sets, t)))
    several = labelled()
    roots = components(links.unionByName(_verified(pairs(several, several, F.col("u.root") < F.col("c.root")), sets, t)))

    place = F.struct("doc_order", "text_hash", "start_word")
    known = cut(again.join(roots.withColumnRenamed("node", "cls"), "cls", "full").select("cls", F.coalesce("root", "cls").alias("root")))
    members = cut(found.drop("shingles").distinct().join(known, "cls"))
    spans = cut(members.groupBy("root").agg(F.min(place).alias("first"), F.min(F.struct("doc_order", "text_hash")).alias("low"),
                                            F.max(F.struct("doc_order", "text_hash")).alias("high"))
                .filter("low != high").select("root", "first"))
    within = Window.partitionBy("doc_order", "text_hash").orderBy("number")
    run = Window.partitionBy("doc_order", "text_hash", "island")
    rows = (members.join(spans, "root").withColumn("island", F.col("number") - F.row_number().over(within))
            .withColumns({"passage_start": F.min("start_word").over(run), "passage_words": F.sum("n_words").over(run)})
            .filter(F.col("passage_words") >= min_words))
    return rows.select(F.nullif("doc_order", F.lit(_LAST)).alias("doc_id"), "text_hash", "start_word", "n_words", "passage_start", "passage_words",
                       F.nullif("first.doc_order", F.lit(_LAST)).alias("first_doc_id"), F.col("first.start_word").alias("first_start_word"),
                       (place != F.col("first")).alias("removed"))
