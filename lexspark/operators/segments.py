"""Conversations as segments (INS-10, 12..15): a row per turn with its place in
the rendered text, so that no conversation is collected into one row.

A turn renders to ``<|im_start|>role⏎content⏎<|im_end|>⏎``. Each segment ends
with an end marker and a line feed, which nothing merges across: a region that
begins in a segment ends in it, words and sub-word tokens don't span segments,
and every segment can be scanned by itself. What a segment needs from the ones
before it are running sums, taken in two levels: over ranges of turns, then
within a range, so that a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import conversation as CV
from ..functions import patterns as P

RANGE = 1024  # turn numbers of a range
ROLES = ("system", "user", "assistant")


def running(df: DataFrame, conv_col: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with exclusive running sums (long, named by ``sums``) over each conversation's rows in
    the order of ``order``, whose first column is the turn number."""
    part = F.floor(F.col(order[0]) / RANGE)
    rows = df.withColumn("_range", part).withColumns({f"_{k}": F.coalesce(e, F.lit(0)).cast("long") for k, e in sums.items()})
    before = Window.partitionBy(conv_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(conv_col, "_range").agg(*[F.sum(f"_{k}").alias(f"_r_{k}") for k in sums])
    ranges = ranges.select(conv_col, "_range", *[F.coalesce(F.sum(f"_r_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    within = Window.partitionBy(conv_col, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (conv_col, "_range")]
    joined = rows.alias("l").join(ranges.alias("r"), same[0] & same[1]).select("l.*", *[f"r._b_{k}" for k in sums])
    totals = {k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in sums}
    return joined.withColumns(totals).select(*df.columns, *sums)


def rendered_turn(role: str = "role", text: str = "text") -> Column:
    """What a turn adds to the rendered text: nothing for other roles and null contents."""
    piece = F.concat(F.lit(P.IM_START), F.col(role), F.lit("\n"), F.col(text), F.lit(f"\n{P.IM_END}\n"))
    return F.coalesce(F.when(F.col(role).isin(*ROLES), piece), F.lit(""))


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, piece, start, end: every turn's rendered piece and its character offsets
    (from 0, end exclusive) in the rendered conversation. Pieces of other roles and null contents
    are empty. Turns of equal number are in the order of role and text."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("_text"),
                        rendered_turn(role_col, text_col).alias("piece"))
    placed = running(rows, "conv_id", ["turn", "role", "_text"], {"start": F.length("piece")})
    return placed.select("conv_id", "turn", "role", "piece", "start", (F.col("start") + F.length("piece")).alias("end"))


def assistant_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, span_no, start, end, content of every assistant region (INS-13) of ``segments``:
    between an assistant marker and the next end marker."""
    spans = pieces.filter(F.col("piece").contains(P.ASSISTANT_MARKER)).select(
        "conv_id", "turn", "start", F.split("piece", CV._SPAN).alias("_gaps"), F.posexplode(CV.assistant_contents("piece")).alias("_k", "content"))
    lead, gap = len(P.ASSISTANT_MARKER) + len(P.IM_END), F.length(F.element_at("_gaps", F.col("_k") + 1))
    spans = spans.withColumn("_gap", gap)  # text between regions
    within = Window.partitionBy("conv_id", "turn", "start").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.col("_gap") + F.coalesce(F.sum(F.col("_gap") + F.length("content") + lead).over(within), F.lit(0)) + len(P.ASSISTANT_MARKER)
    placed = spans.select("conv_id", "turn", at.alias("start"), "content").withColumn("end", F.col("start") + F.length("content"))
    return running(placed, "conv_id", ["turn", "start"], {"span_no": F.lit(1)}).select("conv_id", "span_no", "start", "end", "content")


def word_mask(pieces: DataFrame) -> DataFrame:
    """conv_id, turn, start, n_tokens, n_loss: words of each segment, and those inside assistant
    regions (INS-14 over whitespace words; words with a marker don't count)."""
    words = pieces.select("conv_id", "turn", "start", F.posexplode_outer(CV.whitespace_tokens("piece")).alias("_at", "_w"))
    before = Window.partitionBy("conv_id", "turn", "start").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.col("_w").endswith(f"{P.IM_START}assistant")
    closed = F.col("_w").contains(P.IM_END)
    last_open = F.max(F.when(opened, F.col("_at"))).over(before)
    last_close = F.max(F.when(closed, F.col("_at"))).over(before)
    inside = last_open.isNotNull() & (last_close.isNull() | (last_close < last_open)) & ~closed & ~F.col("_w").contains(P.IM_START)
    flagged = words.select("conv_id", "turn", "start", "_w", F.coalesce(inside, F.lit(False)).alias("_in"))
    return flagged.groupBy("conv_id", "turn", "start").agg(F.count("_w").alias("n_tokens"), F.count_if("_in").alias("n_loss"))


# ------------------------------------------------------------------ sub-word tokens

@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    return t


def inside(starts: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which offsets lie in one of the spans; both in order."""
    begin, end = np.array([s for s, _ in spans], np.int64), np.array([e for _, e in spans], np.int64)
    return np.searchsorted(begin, starts, "right") > np.searchsorted(end, starts, "right")


def _encode(path: str):
    region = re.compile(CV._SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            ids, mask, sizes = [], [], [0]
            for piece in batch.column("piece").to_pylist():
                found = tokenizer.encode(piece, add_special_tokens=False)
                spans = [m.span(1) for m in region.finditer(piece)]
                ids.append(np.array(found.ids, np.int32))
                mask.append(inside(np.array([a for a, _ in found.offsets], np.int64), spans).astype(np.int8))
                sizes.append(sizes[-1] + len(found.ids))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind))) for x, kind in ((ids, np.int32), (mask, np.int8))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "turn", "start")], *lists], names=["conv_id", "turn", "start", "ids", "mask"])

    return run


def subword_tokens(pieces: DataFrame, path: str, max_len: int = 2048) -> DataFrame:
    """conv_id, turn, start, token_start, n_tokens, ids, mask of each segment (INS-14, 15): its
    sub-word tokens as a ``tokenizers`` file gives them, cut where the conversation has ``max_len``
    tokens; ``mask`` is 1 for tokens that begin inside an assistant region. ``token_start`` and
    ``n_tokens`` are of the whole conversation, before the cut.

    Segments are encoded by themselves: byte-level vocabularies split text behind a line feed that
    a marker follows, so that gives the tokens of the whole text. Null ids are kept."""
    encoded = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "start", "piece").mapInArrow(
        _encode(path), "conv_id long, turn long, start long, ids array<int>, mask array<byte>")
    placed = running(encoded, "conv_id", ["turn", "start"], {"token_start": F.size("ids")})
    left = F.greatest(F.lit(0), F.least(F.size("ids").cast("long"), max_len - F.col("token_start"))).cast("int")
    return placed.select("conv_id", "turn", "start", "token_start", F.size("ids").alias("n_tokens"), F.slice("ids", 1, left).alias("ids"), F.slice("mask", 1, left).alias("mask"))
