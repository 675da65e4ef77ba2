"""Phrase collocations from count streams kept in prefix and in suffix order.

Counting goes by length: phrases of n words are counted only where both of their parts of n - 1
words reach the least count, which loses no phrase that reaches it. Tasks hand on sorted runs of
counts; a run's pieces meet by range and are merged there. The streams of counts that are left are
then joined in step: in prefix order (first words) with the counts of the first part, in suffix
order (last words) with those of the rest, and the same two orders give the largest count of an
extension to the right and to the left.

A word is known by a 64-bit hash of its language and its bytes. That no two words of the corpus
share one is checked when words are counted; otherwise another seed is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .tokens import Tokens, bytes_in, tokens_of
from .words import bit_set, bits, mix

WORD = ~bytes_in("\t ", (10, 13), ".,;:!?")
BREAK = bytes_in((10, 13), ".,;:!?")
CHUNK = 1 << 21  # words whose counts a task holds before it hands them on; 21 bits number them
RANGE = 1 << 21  # words of the corpus for each range of a count stream
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _keyed(batch: pa.RecordBatch, seed: int) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Words with hashes of their own in each language; the number of each row's language; languages."""
    t = tokens_of(batch.column("text"), WORD, BREAK)
    lang = batch.column("lang").dictionary_encode()
    names = lang.dictionary.to_pylist()
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") for x in names] or [0], np.uint64)
    of_row = lang.indices.to_numpy()
    t.hash = mix(t.hash ^ salt[of_row[t.row]], seed)
    return t, of_row, np.array(names, object)


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            t, of_row, names = _keyed(batch, seed)
            h, at, n = np.unique(t.hash, return_index=True, return_counts=True)
            if len(h):
                held.append((h, n, pa.DictionaryArray.from_arrays(pa.array(of_row[t.row[at]]), pa.array(names)).cast(pa.string()), t.strings(at)))
                size += len(h)
            if size > CHUNK:
                yield from _merged_words(held)
                held, size = [], 0
        if held:
            yield from _merged_words(held)

    return run


def _merged_words(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    h, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    lang, word = (pa.concat_arrays([x[k] for x in held]) for k in (2, 3))
    h, at, back = np.unique(h, return_index=True, return_inverse=True)
    n = np.bincount(back, n).astype(np.int64)
    at = pa.array(at)
    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), lang.take(at), word.take(at), pa.array(n)], names=["h", "lang", "word", "n"])


def _code(words: list[np.ndarray]) -> np.ndarray:
    """One number for the words of a phrase, for bit sets and ranges only."""
    out = words[0]
    for w in words[1:]:
        out = mix(out * _TURN + w, 1)
    return out


def _count_runs(size: int, seed: int, wanted: np.ndarray, ranges: int):
    """Sorted runs of counts of phrases of ``size`` words, by range: only those whose parts of one
    word less have their bits in ``wanted``."""
    def chunk(h: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, own = np.unique(h, return_inverse=True)
        reach = len(h) - size + 1
        if reach <= 0:
            return
        whole = group[:reach] == group[size - 1:]
        if size == 2:
            good = bit_set(wanted, ids)[own]
            whole &= good[:-1] & good[1:]
        else:
            pair = np.zeros(len(h) - 1, bool)
            same = np.flatnonzero(group[:-1] == group[1:])
            pair[same] = bit_set(wanted, _code([h[same], h[same + 1]]))
            whole &= pair[:-1] & pair[1:]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        code = own[at].astype(np.int64)
        for k in range(1, size):
            code = code << 21 | own[at + k]
        code.sort()
        new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        n = np.diff(np.append(new, len(code)))
        words = [ids[code[new] >> 21 * (size - 1 - k) & (1 << 21) - 1] for k in range(size)]
        where = (_code(words) >> np.uint64(40)).astype(np.int64) * ranges >> 24
        order = np.argsort(where, kind="stable")  # each range's part stays a run in prefix order
        cuts = np.flatnonzero(np.diff(where[order], prepend=-1, append=-1))
        words, n = [w[order].view(np.int64) for w in words], n[order].astype(np.int32)
        starts = cuts[:-1]
        columns = [pa.array(where[order][starts])] + [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in [*words, n]]
        yield pa.RecordBatch.from_arrays(columns, names=["range", *_names(size), "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, group, last = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            t, _, _ = _keyed(batch, seed)
            if not len(t.hash):
                continue
            new = np.concatenate(([True], (t.row[1:] != t.row[:-1]) | (t.piece[1:] != t.piece[:-1])))
            h, group = np.concatenate((h, t.hash)), np.concatenate((group, last + np.cumsum(new)))
            last = int(group[-1])
            while len(h) > CHUNK - 2:
                yield from chunk(h[:CHUNK - 2], group[:CHUNK - 2])
                h, group = h[CHUNK - 1 - size:], group[CHUNK - 1 - size:]  # the last words begin phrases still
        yield from chunk(h, group)

    return run


def _names(size: int) -> list[str]:
    return [f"w{k + 1}" for k in range(size)]


def _merge_runs(size: int, least: int):
    """The runs of one range as one stream, without phrases below the least count."""
    def run(runs: pa.Table) -> pa.Table:
        words = [runs.column(c).combine_chunks().flatten().to_numpy() for c in _names(size)]
        n = runs.column("n").combine_chunks().flatten().to_numpy()
        order = np.lexsort(words[::-1])
        words = [w[order] for w in words]
        new = np.concatenate(([True], np.any([w[1:] != w[:-1] for w in words], axis=0)))
        total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))
        words = [w[new][total >= least] for w in words]
        code = _code([w.view(np.uint64) for w in words]).view(np.int64)
        return pa.table([*words, total[total >= least], code], names=[*_names(size), "f", "cls"])

    return run


def _counted(texts: DataFrame, size: int, seed: int, wanted: np.ndarray, n_words: int, least: int) -> DataFrame:
    ranges = min(1 << 16, max(1, -(-n_words // RANGE)))
    fields = ", ".join(f"{c} array<long>" for c in _names(size))
    runs = texts.mapInArrow(_count_runs(size, seed, wanted, ranges), f"range long, {fields}, n array<int>")
    out = ", ".join(f"{c} long" for c in _names(size))
    return written(runs.groupBy("range").applyInArrow(_merge_runs(size, least), f"{out}, f long, cls long"), f"phrases{size}")


def _vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """(h, lang, word, f) of all words under a seed that gives each one a hash of its own, and that seed."""
    for seed in range(16):
        counts = texts.mapInArrow(_count_words(seed), "h long, lang string, word string, n long")
        words = written(counts.groupBy("h").agg(F.min(F.struct("lang", "word")).alias("w"), F.max(F.struct("lang", "word")).alias("other"), F.sum("n").alias("f")), "words")
        if words.filter("w != other").isEmpty():
            return words.select("h", "w.lang", "w.word", "f"), seed
    raise ValueError("words share hashes under all seeds")


def phrases(docs: DataFrame, least: int = 10, cover: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of two or three words that occurs ``least``
    times or more in its language and isn't covered: no longer phrase holds it with ``cover``
    percent of its count or more.

    A to Z are lower-cased; ``.,;:!?`` and line breaks end pieces, spaces and tabs words; phrases
    lie within pieces and all their occurrences count. A phrase is cut in two where its score
    floor(1000000 a a / (l r)) is lowest, ties at the first place; l and r count the two parts. n
    counts the words of the language. A null language is ``und``; null and empty texts have no
    words; repeated rows count each time; an empty table gives an empty result; further columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    words, seed = _vocabulary(texts)
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    n_words = words.agg(F.sum("f")).first()[0] or 0
    two = _counted(texts, 2, seed, bits(frequent.select(F.col("h").alias("cls"))), n_words, least)
    three = _counted(texts, 3, seed, bits(two), n_words, least)

    one = frequent.select("h", "f")
    pairs = written(_in_step(_in_step(two.drop("cls"), one.toDF("w1", "l")), one.toDF("w2", "r")), "pairs")
    # in prefix order with the first two words, in suffix order with the last two
    first, rest = pairs.select("w1", "w2", F.col("f").alias("l2"), F.col("l").alias("l1")), pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1"), F.col("r").alias("r2"))
    triples = written(_in_step(_in_step(three.drop("cls"), first), rest), "triples")
    longer = F.greatest(F.coalesce("right", F.lit(0)), F.coalesce("left", F.lit(0)))
    open_pairs = (_in_step(_in_step(pairs, triples.groupBy("w1", "w2").agg(F.max("f").alias("right")), "left"),
                           triples.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("f").alias("left")), "left")
                  .filter(100 * longer < cover * F.col("f")))
    found = open_pairs.select("w1", "w2", F.lit(None).cast("long").alias("w3"), F.col("f").alias("a"), "l", "r", _score("f", "l", "r").alias("score"))
    early, late = _score("f", "l1", "r1"), _score("f", "l2", "r2")
    found = found.unionByName(triples.select("w1", "w2", "w3", F.col("f").alias("a"), F.when(early <= late, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                                             F.when(early <= late, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least(early, late).alias("score")))
    return _spelled(found, frequent, sizes)


def best_phrases(docs: DataFrame, top: int = 2000, **options) -> DataFrame:
    """The ``top`` phrases of each language, ranked by score and count, both descending, and phrase:
    lang, rank, phrase, a, l, r, n, score. Null, empty and repeated rows as in ``phrases``."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = phrases(docs, **options).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _in_step(stream: DataFrame, counts: DataFrame, how: str = "inner") -> DataFrame:
    """Both sides in the order of the columns they share, joined in one pass over each."""
    return stream.join(counts.hint("merge"), [c for c in counts.columns if c in stream.columns and c.startswith("w")], how)


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """Whole numbers of 38 digits: exact for counts up to 10**16."""
    wide = {c: F.col(c).cast("decimal(19,0)") for c in (a, l, r)}
    return F.call_function("div", (F.lit(1000000).cast("decimal(7,0)") * wide[a] * wide[a]).cast("decimal(38,0)"), (wide[l] * wide[r]).cast("decimal(38,0)")).cast("long")


def _spelled(found: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    def named(k: int) -> DataFrame:
        return words.select(F.col("h").alias(f"w{k}"), F.col("word").alias(f"s{k}"))

    out = found.join(words.select(F.col("h").alias("w1"), F.col("word").alias("s1"), "lang"), "w1").join(named(2), "w2").join(named(3), "w3", "left")
    return out.join(F.broadcast(sizes), "lang").select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", "l", "r", "n", "score")


def oracle_sql(least: int = 10, cover: int = 50, top: int = 2000) -> str:
    """The same result in DuckDB SQL, from all phrases of all pieces."""
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3]) AS k) AS sizes WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, a, unnest(CASE WHEN k = 2 THEN [1] ELSE [1, 2] END) AS cut FROM f WHERE k > 1 AND a >= {least}),
s AS (SELECT c.lang, c.k, c.g, c.a, c.cut, x.a AS l, y.a AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
e AS (SELECT lang, g[1:2] AS g, a FROM f WHERE k = 3 AND a >= {least} UNION ALL SELECT lang, g[2:3], a FROM f WHERE k = 3 AND a >= {least}),
m AS (SELECT lang, g, max(a) AS longer FROM e GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, n.n, b.score
  FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g JOIN n ON n.lang = b.lang WHERE 100 * coalesce(m.longer, 0) < {cover} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY rank <= {top}"""
