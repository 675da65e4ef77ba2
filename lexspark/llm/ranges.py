"""Rows of numbers dealt by ranges of a hash, many to one row of Spark.

A task hands on what it has made as one row for each range, with a list for every column; the rows
of a range then meet in one group, whose size the number of ranges bounds. A shuffle of few rows
with long lists costs a fraction of one with a row for each number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import mix

HELD = 1 << 19  # numbers of a column that a task holds before it hands them on
RANGE = 1 << 19  # of a range


def ranges_for(rows: int) -> int:
    return min(1 << 20, max(1, -(-rows // RANGE)))


def dealt(key: np.ndarray, columns: dict[str, np.ndarray], ranges: int) -> pa.RecordBatch:
    """A row for each range of ``key`` that occurs: its number and its part of the columns, in their order."""
    where = ((mix(key.astype(np.uint64), 3) >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where = where[order]
    cuts = np.flatnonzero(np.diff(where, prepend=-1, append=-1)) if len(where) else np.zeros(1, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[order])) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(where[cuts[:-1]]), *lists], names=["range", *columns])


class Held:
    """Columns that a task gathers; full when it is time to hand them on."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.rows = names, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.rows += len(columns[0])
        return self.rows >= HELD

    def take(self) -> dict[str, np.ndarray]:
        out = {n: np.concatenate(x) for n, x in zip(self.names, zip(*self.parts))}
        self.parts, self.rows = [], 0
        return out


def flat(rows: pa.Table, name: str) -> np.ndarray:
    """A list column of a range's rows as one array."""
    return rows.column(name).combine_chunks().flatten().to_numpy()
