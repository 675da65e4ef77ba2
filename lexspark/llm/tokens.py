"""Words of many texts at once, by classes of bytes.

Only A-Z are lower-cased and every byte beyond ASCII is of one class, so that bytes tell words as
well as characters do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import _BYTE, SEGMENT, _powers, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bytes_in(*ranges: tuple[int, int] | str) -> np.ndarray:
    """A flag for each of the 256 bytes: those of the strings and closed ranges."""
    out = np.zeros(256, bool)
    for r in ranges:
        if isinstance(r, str):
            out[list(r.encode())] = True
        else:
            out[r[0]:r[1] + 1] = True
    return out


@dataclass
class Tokens:
    """Of every word in order: its row, its hash, the number of break bytes before it, and its
    place in ``data`` (lower-cased)."""

    row: np.ndarray
    hash: np.ndarray
    piece: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at some places, as text."""
        size = self.end[at] - self.begin[at]
        offsets = np.concatenate(([0], np.cumsum(size)))
        src = np.repeat(self.begin[at] - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[src])]).cast(pa.string())


def tokens_of(texts: pa.Array, word: np.ndarray, breaks: np.ndarray | None = None, seed: int = 0) -> Tokens:
    """Maximal runs of ``word`` bytes in each text; null texts have none.

    A word's hash is a polynomial of its bytes, from running sums over segments of the texts that
    end outside words, so that no word is handled by itself.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    starts = offsets - offsets[0]
    parts: list[tuple[np.ndarray, ...]] = []
    a, broken = 0, 0
    while a < len(data):
        b = _segment_end(data, starts, word, a)
        part = data[a:b]
        inside = word[part]
        first = starts[np.searchsorted(starts, a, "right"):np.searchsorted(starts, b, "left")] - a  # texts that begin within
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        new[first] = inside[first]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[first - 1] = inside[first - 1]
        begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
        up, down = _powers(max(SEGMENT, 1 << (len(part) - 1).bit_length()))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[:len(part)], dtype=np.uint64)))
        h = mix((sums[end] - sums[begin]) * down[begin], seed)
        if breaks is None:
            piece = np.zeros(len(begin), np.int64)
        else:
            passed = np.cumsum(breaks[part])
            piece, broken = broken + passed[begin], broken + int(passed[-1])
        parts.append((np.searchsorted(starts, begin + a, "right") - 1, h, piece, begin + a, end + a))
        a = b
    empty = np.zeros(0, np.int64)
    row, h, piece, begin, end = (np.concatenate(x) for x in zip(*parts)) if parts else (empty, empty.astype(np.uint64), empty, empty, empty)
    return Tokens(row, h, piece, begin, end, data)


def _segment_end(data: np.ndarray, starts: np.ndarray, word: np.ndarray, a: int) -> int:
    """Where a segment from ``a`` ends: outside words, after ``SEGMENT`` bytes at most unless a single word is longer."""
    b = a + SEGMENT
    while b < len(data):
        outside = np.flatnonzero(~word[data[a:b]])
        begun = starts[np.searchsorted(starts, b, "right") - 1]
        end = max(a + int(outside[-1]) + 1 if len(outside) else a, int(begun))
        if end > a:
            return end
        b = a + 2 * (b - a)
    return len(data)
