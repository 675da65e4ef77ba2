"""Words of many texts at once, and bounded sets of their keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 16  # bytes of text looked at in one go, few enough for a processor's cache; a longer line is looked at whole
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """In segments of whole lines: row and line number of every line; line and hash of every word.

    The hash of a word is a polynomial of its bytes, taken from running sums over the segment, so
    that no word is handled by itself.
    """
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[0] == offsets[-1]:
        return
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    breaks = np.flatnonzero(data == 10) + 1
    lines = np.union1d(offsets[:-1], breaks)
    lines = lines[lines < len(data)]
    row = np.searchsorted(offsets, lines, "right") - 1
    number = np.searchsorted(breaks, lines, "right") - np.searchsorted(breaks, offsets[row], "right")
    first = 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(lines, lines[first] + SEGMENT, "right")) - 1)
        if last == len(lines) - 1 and len(data) <= lines[first] + SEGMENT:
            last = len(lines)
        a, b = lines[first], lines[last] if last < len(lines) else len(data)
        part, starts = data[a:b], lines[first:last] - a
        word = (part != 32) & (part - np.uint8(9) > 4)
        new = word.copy()
        new[1:] &= ~word[:-1]
        new[starts] = word[starts]
        begin = np.flatnonzero(new)
        old = word
        old[:-1] &= ~word[1:] | new[1:]
        end = np.flatnonzero(old) + 1
        up, down = _powers(max(SEGMENT, 1 << (int(b - a) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE.take(part) * up[:len(part)], out=sums[1:])
        line = np.repeat(np.arange(len(starts)), np.diff(np.searchsorted(begin, starts), append=len(begin)))
        yield row[first:last], number[first:last], line, mix((sums[end] - sums[begin]) * down[begin], 0)
        first = last


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, so that sums over sets of hashes don't cancel."""
    h = (h ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def bits(keys: DataFrame) -> np.ndarray:
    """A bit for each key modulo their number: 16 bits a key, and 4 MB at most. More keys share
    bits then, which lets more lines pass and loses none."""
    n = 1 << min(25, max(16, (16 * keys.count()).bit_length()))
    bit = F.pmod(F.col("cls"), F.lit(n))  # n is a power of two: the same for signed and unsigned
    rows = (keys.select(bit.alias("bit")).selectExpr("shiftright(bit, 6) AS at", "shiftleft(1L, cast(bit % 64 AS int)) AS b")
            .groupBy("at").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(n // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def bit_set(wanted: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys have their bit in ``wanted``."""
    bit = keys.view(np.uint64) % np.uint64(64 * len(wanted))
    return (wanted[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
