"""Packing tokenised documents into training sequences, shortest pack first over the length histogram.

Documents become pieces: as many full sequences as they fill, and a rest. The histogram of piece
lengths, no longer than a sequence, goes to the driver. There the lengths are placed longest first,
each into the shortest packs that have room, as counts of packing patterns, never piece by piece.
A pattern's slots are ranges of ranks: the k-th piece of a length finds its sequence and offset by
its rank, which Spark counts without bringing all pieces of a length together.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches

END_ID = 1
CACHE = 1 << 19  # words whose ids a worker keeps, and as many older ones, of at most so many characters:
CACHED_CHARS = 64
GROUP = 64  # texts encoded together
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that byte-level pre-tokenisation never joins: a word with the space before it, and white space.
_CHUNKS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NOT_PLAIN = re.compile(rf"[{_SPACE}][{_SPACE}]|[{_SPACE.replace('\t-\r ', '\t\x0b-\r')}]")
_NOT_PLAIN_ASCII = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")


def _plain(text: str) -> bool:
    """Words with a single space or line feed between them."""
    return not (any(x in text for x in _NOT_PLAIN_ASCII) if text.isascii() else _NOT_PLAIN.search(text))


_TAILS = ".,;:!?"  # after a word of letters, one of these is a unit of its own


class ChunkEncoder:
    """Ids of whole texts as little-endian 32-bit numbers, by a byte-level tokeniser of ``tokenizers``.

    A text is encoded in chunks cut where its pre-tokenisation cuts anyway, and chunks seen before
    come from bounded caches. In a plain text they are words, with the space or line feed before
    them. New words are encoded together: each begins with white space after another character, so
    they stay apart, and the bytes of their tokens tell whose a token is. A text in which a special
    string stands goes to the library whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a token's text has a character for each byte
        self.feed, *tails = self._encode(["\n", *_TAILS])
        self.tails = dict(zip(_TAILS, tails))
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._new_words({})

    def _new_words(self, older: dict[str, bytes]) -> None:
        """Words are known by themselves, or with the line feed before them."""
        self.older, self.words = older, dict(zip(["", "\n"], self._encode([" ", "\n"])))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        words, older = self.words, self.older
        stems = {w: w[:-1] for w in missing if w[-1] in _TAILS and w[:-1].lstrip("\n").isalpha() and max(w) < "\u0250"}
        new = []
        for w in {*missing.difference(stems), *stems.values()}:
            if w not in words:
                ids = older.get(w)
                if ids is None:
                    new.append(w)
                else:
                    words[w] = ids
        texts = [w if w[0] == "\n" else " " + w for w in new]
        joined = b"".join(self._encode(["".join(texts[i:i + 100]) for i in range(0, len(texts), 100)]))
        ends = np.cumsum(self.n_bytes[np.frombuffer(joined, "<u4")])
        stop = np.searchsorted(ends, np.cumsum([len(t.encode("utf-8", "surrogatepass")) for t in texts])) + 1
        at = [0, *(4 * stop).tolist()]
        words.update((w, joined[i:j]) for w, i, j in zip(new, at, at[1:]))
        words.update((w, words[stem] + self.tails[w[-1]]) for w, stem in stems.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > self.cache:
            self.chunks = {}
        if len(self.words) > self.cache:  # words still in use come back from the older generation
            self._new_words(self.words)
        out: list[bytes] = []
        later: list[tuple[int, list[str]]] = []
        missing: set[str] = set()
        known = self.words.get
        for t in texts:
            if any(s in t for s in self.special):
                out.append(self._encode([t])[0])
            elif not _plain(t):
                out.append(self._by_chunks(_CHUNKS.findall(t)))
            else:  # as if a line feed stood in front
                words = ("\n" + t).replace("\n", " \n").split(" ")
                del words[0]
                ids = list(map(known, words))
                new = [w for w, i in zip(words, ids) if i is None]
                if new:
                    missing.update(new)
                    later.append((len(out), words))
                    out.append(b"")
                else:
                    out.append(b"".join(ids)[len(self.feed):])
        if missing:
            self._learn(missing)
        for at, words in later:
            out[at] = b"".join(map(self.words.__getitem__, words))[len(self.feed):]
        for w in missing:
            if len(w) > CACHED_CHARS:
                del self.words[w]
        return out

    def _by_chunks(self, chunks: list[str]) -> bytes:
        new = list({*chunks}.difference(self.chunks))
        found = dict(zip(new, self._encode(new)))
        self.chunks.update((c, i) for c, i in found.items() if len(c) <= CACHED_CHARS)
        return b"".join([found[c] if c in found else self.chunks[c] for c in chunks])


@cache
def _encoder(path: str, words: int) -> ChunkEncoder:
    """A worker keeps its encoder, and what that has cached, from task to task."""
    return ChunkEncoder(path, words)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False, cached: int = CACHE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, as little-endian 32-bit numbers) of
    every piece. A null text is an empty one; each document ends with id 1. A worker keeps the ids of
    ``cached`` words, and as many older ones."""
    small_batches(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path, cached), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for first in range(0, b.num_rows, GROUP):
                texts = [t or "" for t in b.column(1).slice(first, GROUP).to_pylist()]
                for row, ids in enumerate(encoder.encode(texts), first):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        piece = ids[4 * at:4 * (at + length)]
                        rows.append((row, at, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None))
            row, *columns = zip(*rows) if rows else [()] * 6
            out = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(columns[4], pa.binary())] * with_ids, names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths in a pack) for all pieces, placed longest first into the shortest pack
    with room; where none has room, new packs take as many of the length as fit."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by space left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((r for r in room if r >= length and room[r]), default=0)
            if not space:
                each = size // length
                if left >= each:
                    room[size - each * length].append((left // each, [length] * each))
                if left % each:
                    room[size - left % each * length].append((1, [length] * (left % each)))
                break
            n, pack = room[space].pop()
            take = min(n, left)
            if n > take:
                room[space].append((n - take, pack))
            room[space - length].append((take, [*pack, length]))
            left -= take
    return [x for packs in room.values() for x in packs]


def _slots(packs: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """For ranges of (length, rank), in order: first key, first sequence, offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, pack in packs:
        at = 0
        for length in pack:
            rows.append((_key(length, used[length]), sequence, at))
            used[length] += n
            at += length
        sequence += n
    keys, first, offset = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return keys, first, offset


def _key(length, rank):
    return (length << 44) + rank


def _with_rank(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``rows`` with their rank, from 0, among the rows of their length, ordered by a bucket of the
    row number and then by it. A length has as many buckets as its count asks for, so that a window
    never holds more than a small share of all rows, however many share a length."""
    spark = rows.sparkSession
    target = min(200_000, max(64, sum(histogram.values()) // 1024))
    schema = "length long, buckets long"
    buckets = F.broadcast(spark.createDataFrame([(k, n // target + 1) for k, n in histogram.items()], schema))  # a row per length
    dealt = rows.join(buckets, "length").withColumn("bucket", F.pmod(F.xxhash64("piece_no"), F.col("buckets")))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    own = Window.partitionBy("length", "bucket").orderBy("piece_no")
    return (dealt.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["length", "bucket"])
            .withColumn("rank", F.col("base") + F.col("rank")).drop("bucket", "buckets", "base"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False, cached: int = CACHE) -> DataFrame:
    """Every piece with sequence_id (from 0) and offset: pieces lie in a sequence without gaps.

    Repeated rows and null ids are documents of their own; empty and null texts are pieces of the
    closing id alone; an empty table gives an empty result; further columns are ignored.
    """
    cut_up = cut(pieces(docs, tokenizer_path, length, id_col, text_col, with_ids, cached).withColumn("piece_no", F.monotonically_increasing_id()))
    histogram = dict(cut_up.groupBy("length").count().collect())  # at most a row per length
    keys, first, offset = _slots(patterns(histogram, length)) if histogram else (np.zeros(0, np.int64),) * 3

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = _key(lengths.to_numpy(np.int64), rank.to_numpy(np.int64))
        at = np.searchsorted(keys, key, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + key - keys[at], "offset": offset[at]})

    ranked = _with_rank(cut_up, histogram).withColumn("_at", place("length", "rank"))
    columns = [c for c in cut_up.columns if c != "piece_no"]
    return ranked.select(*columns, "_at.sequence_id", "_at.offset")
