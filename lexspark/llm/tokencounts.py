"""Exact token counts at every prefix of a text, by dynamic programming over its characters.

For byte-pair merges by score, the tokens of a prefix are those of a shorter prefix and one more
token: the one whose left neighbour, the last token of that shorter prefix, stays as it is when the
two are encoded together. So the last token and the count of every prefix follow from the shorter
ones, and a text that is to be cut to a budget, or counted up to any place, isn't encoded again.

Pieces of the model hold the mark of a space at their start only (or nothing else), so nothing
merges across the start of a run of spaces: a text is a row of chunks (spaces, then other
characters) whose prefix counts are independent. The state at a chunk's prefix, its count and the
length of its last token, depends on that prefix alone and is kept for later chunks that begin
alike, in a bounded cache. Merges of equal score can depend on what follows: the library counts
the prefixes of chunks that hold a piece whose score is not its own (runs of spaces).
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CACHE = 1 << 19  # prefixes whose states a worker keeps, and as many older ones
KEPT = 1 << 19  # words whose counts it keeps, and pairs of tokens, and as many older ones
CACHED_CHARS = 64  # states of a longer chunk are dropped when it is done
GROUP = 64  # texts counted together
_MARK = "▁"
_CHUNKS = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+")


class Kept(dict):
    """A bounded cache of two generations: what is still in use comes back from the older one."""

    def __init__(self, size: int):
        self.size, self.older = size, {}

    def turn(self) -> None:
        """Called now and then: a full generation becomes the older one."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()

    def find(self, key):
        found = self.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self[key] = found
        return found


class PrefixCounter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = m = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in ids}
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in self.score):
            raise ValueError("pieces that reach across a space or a line feed are beyond this counter")
        self.longest = max(map(len, self.score))
        met = Counter(x for p, x in self.score.items() if len(p) > 1)
        tied = [p for p, x in self.score.items() if len(p) > 1 and met[x] > 1]
        self.tied = [p for p in tied if not any(q in p for q in tied if q != p)]  # the rest hold one of these
        self.tokens = {p for p in self.score if self.merged(p) == [p]}  # others never result from merges
        self.states = Kept(CACHE)  # prefix of a chunk -> count * 64 + length of its last token
        self.stays = Kept(KEPT)
        self.spaced, self.bare = Kept(KEPT), Kept(KEPT)  # counts of words, with a mark before them or without

    def merged(self, text: str) -> list[str]:
        """The text's tokens: ever the neighbours whose union scores best are merged, the first at a tie."""
        parts = list(text)
        while len(parts) > 1:
            at = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not at:
                break
            i = min(at)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stay(self, a: str, b: str) -> bool:
        found = self.stays.find((a, b))
        if found is None:
            found = self.stays[a, b] = self.merged(a + b) == [a, b]
        return found

    def _state(self, chunk: str, i: int) -> int:
        """Of the prefix of i characters; those of shorter prefixes are worked out on the way."""
        states, older, tokens, stays = self.states, self.states.older, self.tokens, self.stays
        known = i
        while known and states.find(chunk[:known]) is None:
            known -= 1
        for k in range(known + 1, i + 1):
            for j in range(max(0, k - self.longest), k):
                piece = chunk[j:k]
                if piece not in tokens and k - j > 1:
                    continue
                count = 0
                if j:
                    before = states.get(chunk[:j])
                    if before is None:
                        before = older.get(chunk[:j])
                        if before is None:
                            before = self._state(chunk, j)
                    last = chunk[j - before % 64:j]
                    stay = stays.get((last, piece))
                    if not (self._stay(last, piece) if stay is None else stay):
                        continue
                    count = before // 64
                count += 1 if piece in tokens else len(piece.encode("utf-8", "surrogatepass"))
                states[chunk[:k]] = count * 64 + k - j
                break
            else:
                raise ValueError(f"no token ends the prefix {chunk[:k]!r}")
        return states[chunk[:i]] if i else 0

    def _long(self, chunk: str) -> list[int]:
        """The states at the prefixes of a long chunk, by position: its prefixes aren't kept."""
        states = [0]
        for k in range(1, len(chunk) + 1):
            for j in range(max(0, k - self.longest), k):
                piece = chunk[j:k]
                if (piece in self.tokens or k - j == 1) and (j == 0 or self._stay(chunk[j - states[j] % 64:j], piece)):
                    states.append((states[j] // 64 + (1 if piece in self.tokens else len(piece.encode("utf-8", "surrogatepass")))) * 64 + k - j)
                    break
        return states

    def _total(self, chunk: str) -> int:
        if any(p in chunk for p in self.tied):
            return len(self.library.encode(chunk[1:]))  # it begins with a mark, which the library adds itself
        return (self._state(chunk, len(chunk)) if len(chunk) <= CACHED_CHARS else self._long(chunk)[-1]) // 64

    def _counts(self, chunk: str) -> list[int]:
        """At the chunk's prefixes, from one character on."""
        if any(p in chunk for p in self.tied):
            return [len(self.library.encode(chunk[1:i])) or 1 for i in range(1, len(chunk) + 1)]
        if len(chunk) > CACHED_CHARS:
            return [x // 64 for x in self._long(chunk)[1:]]
        return [self._state(chunk, i) // 64 for i in range(1, len(chunk) + 1)]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """With the mark that the library puts in front."""
        return _CHUNKS.findall(_MARK + text.replace(" ", _MARK)) if text else []

    def totals(self, texts: list[str]) -> list[int]:
        """The count at the last prefix of each text. Where single spaces separate words, each word
        is a chunk (line feeds merge with nothing and part chunks)."""
        plain = [bool(t) and t[0] != " " and "  " not in t and _MARK not in t for t in texts]
        lines = [[line.split(" ") for line in t.split("\n")] if p else None for t, p in zip(texts, plain)]
        self.states.turn()
        self.stays.turn()
        spaced, bare = set(), set()
        for rows in filter(None, lines):
            spaced.add(rows[0][0])
            bare.update(words[0] for words in rows[1:])
            for words in rows:
                spaced.update(words[1:])
        for found, kept, mark in ((spaced, self.spaced, _MARK), (bare, self.bare, "")):
            kept.turn()
            older = kept.older
            for w in found:
                if w not in kept:
                    n = older.get(w)
                    kept[w] = (self._total(mark + w) if mark or w else 0) if n is None else n
        out = []
        for t, rows in zip(texts, lines):
            if rows is None:
                out.append(sum(map(self._total, self._chunks(t))))
            else:
                n = len(rows) - 1 + self.spaced[rows[0][0]] + sum(self.bare[words[0]] for words in rows[1:])
                out.append(n + sum([sum(map(self.spaced.__getitem__, words[1:])) for words in rows]))
        for found, kept in ((spaced, self.spaced), (bare, self.bare)):
            for w in found:
                if len(w) > CACHED_CHARS:
                    del kept[w]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The token counts of ``text[:0]``, ``text[:1]`` and so on to the whole text."""
        out, done = [], 0
        self.states.turn()
        self.stays.turn()
        for chunk in self._chunks(text):
            counts = self._counts(chunk)
            out.extend([c + done for c in counts])
            done = out[-1]
        return np.array([0, *out[1:]], np.int64)  # the mark in front alone: the library gives an empty text no token

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens."""
        done = used = 0
        self.states.turn()
        self.stays.turn()
        for chunk in self._chunks(text):
            if used + 1 > limit:
                break
            counts = self._counts(chunk)
            if used + counts[-1] > limit:
                done += max((i for i, c in enumerate(counts, 1) if used + c <= limit), default=0)
                break
            done, used = done + len(chunk), used + counts[-1]
        return max(0, done - 1)


@cache
def _counter(path: str) -> PrefixCounter:
    """A worker keeps its counter, and what that has cached, from task to task."""
    return PrefixCounter(path)


def n_tokens(text: Column, model_path: str) -> Column:
    """The count at the last prefix; 0 for null."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        counter = _counter(model_path)
        out: list[int] = []
        for at in range(0, len(texts), GROUP):
            out += counter.totals([t or "" for t in texts[at:at + GROUP]])
        return pd.Series(out, dtype="int64")

    return run(text)


def prefix_counts(text: Column, model_path: str) -> Column:
    """The counts at all prefixes, from the empty one to the whole text (``[0]`` for null)."""
    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        counter = _counter(model_path)
        return pd.Series([counter.prefixes(t or "") for t in texts], dtype=object)

    return run(text)


def truncated(text: Column, model_path: str, limit: int) -> Column:
    """The longest prefix with at most ``limit`` tokens; null stays null."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        counter = _counter(model_path)
        return pd.Series([None if t is None else t[:counter.fitting(t, limit)] for t in texts], dtype=object)

    return run(text)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    Null and empty texts count 0; repeated rows and null ids have rows of their own; an empty table
    stays empty; further columns are ignored. The limit takes no part in the counting.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                          n_tokens(F.col(text_col), model_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
