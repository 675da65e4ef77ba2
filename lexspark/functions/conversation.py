"""Column functions over conversations ``ARRAY<STRUCT<role, content>>`` and
rendered chat text. Higher-order functions only (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def message(role, content) -> Column:
    return F.struct(_c(role).alias("role") if not isinstance(role, str) else F.lit(role).alias("role"),
                    _c(content).alias("content"))


def first_of_role(conv, role: str) -> Column:
    """INS-11: content of the first message with ``role``, else ''."""
    first = F.try_element_at(F.filter(_c(conv), lambda m: m["role"] == role), F.lit(1))
    return F.coalesce(first["content"], F.lit(""))


def render_training_text(conv) -> Column:
    """INS-09: first system, user and assistant message; no newline before
    the end tag and none at the end."""
    s, u, a = (first_of_role(conv, r) for r in ("system", "user", "assistant"))
    return F.concat(F.lit(f"{P.IM_START}system\n"), s, F.lit(f"{P.IM_END}\n{P.IM_START}user\n"), u,
                    F.lit(f"{P.IM_END}\n{P.IM_START}assistant\n"), a, F.lit(P.IM_END))


def render_conversation(conv) -> Column:
    """INS-10: every system/user/assistant message in order, newline before
    and after each end tag; other roles skipped."""
    kept = F.filter(_c(conv), lambda m: m["role"].isin("system", "user", "assistant"))
    parts = F.transform(kept, lambda m: F.concat(F.lit(P.IM_START), m["role"], F.lit("\n"),
                                                 m["content"], F.lit(f"\n{P.IM_END}\n")))
    return F.array_join(parts, "")


_SPAN = r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"


def assistant_contents(text) -> Column:
    """INS-13: contents of assistant turns (start marker … first end marker);
    scanning stops at the first unclosed turn."""
    return F.regexp_extract_all(_c(text), F.lit(_SPAN), F.lit(1))


def assistant_spans(text) -> Column:
    """INS-13: ARRAY<STRUCT<start, end>> character offsets (0-based, end
    exclusive) of the assistant contents, computed from the lengths of the
    pieces between matches (no Python)."""
    t = _c(text)
    contents = assistant_contents(t)
    # text split at every complete span; piece i precedes span i
    pieces = F.split(t, _SPAN)
    marker_len = len(P.ASSISTANT_MARKER)
    end_len = len(P.IM_END)
    n = F.size(contents)
    idx = F.sequence(F.lit(0), n - 1)

    def span(i):
        before = F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda acc, p: acc + F.length(p))
        prev_contents = F.aggregate(F.slice(contents, 1, i), F.lit(0),
                                    lambda acc, c: acc + F.length(c) + marker_len + end_len)
        start = before + prev_contents + marker_len
        return F.struct(start.alias("start"), (start + F.length(F.element_at(contents, i + 1))).alias("end"))

    return F.when(n > 0, F.transform(idx, span)).otherwise(F.array().cast(
        "array<struct<start:int,end:int>>"))


def whitespace_tokens(text) -> Column:
    """Tokens split on whitespace runs ('' → no tokens)."""
    t = F.trim(F.regexp_replace(_c(text), P.WS, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def marker_positions(tokens) -> Column:
    """STRUCT<starts, ends>: token positions of assistant start markers and
    of end markers (computed once per row)."""
    tk = _c(tokens)
    pos = F.sequence(F.lit(0), F.greatest(F.size(tk) - 1, F.lit(0)))
    return F.struct(
        F.filter(pos, lambda i: F.coalesce(F.try_element_at(tk, i + 1), F.lit("")).endswith(
            f"{P.IM_START}assistant")).alias("starts"),
        F.filter(pos, lambda i: F.coalesce(F.try_element_at(tk, i + 1), F.lit("")).contains(P.IM_END)).alias("ends"))


def loss_mask(tokens, markers) -> Column:
    """INS-14 (union of assistant regions): 1 for tokens inside any assistant
    turn, 0 elsewhere, over whitespace tokens of rendered text; marker tokens
    are 0. ``markers`` = ``marker_positions(tokens)`` materialised as its own
    column, so each token only scans the (few) marker positions."""
    tk, mk = _c(tokens), _c(markers)

    def flag(x, i):
        last_start = F.array_max(F.filter(mk["starts"], lambda s: s < i))
        last_end = F.array_max(F.filter(mk["ends"], lambda e: e < i))
        inside = last_start.isNotNull() & (last_end.isNull() | (last_end < last_start))
        is_marker = x.contains(P.IM_END) | x.contains(P.IM_START)
        return F.when(inside & ~is_marker, 1).otherwise(0)

    return F.transform(tk, flag)


def extract_response(generated) -> Column:
    """INS-20: text after the first assistant marker (up to the next one),
    cut at the end tag, trimmed. No marker → NULL."""
    g = _c(generated)
    after = F.try_element_at(F.split(g, r"<\|im_start\|>assistant\n"), F.lit(2))
    cut = F.when(after.contains(P.IM_END), F.split(after, r"<\|im_end\|>")[0]).otherwise(after)
    return py_strip(cut)


def fill_template(template, values) -> Column:
    """INS-07: replace every ``{name}`` by ``values[name]`` (a MAP<STRING,STRING>)."""
    return F.aggregate(F.map_entries(_c(values)), _c(template),
                       lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def unfilled_placeholders(text) -> Column:
    """INS-08: ``{name}`` placeholders left in a text."""
    return F.regexp_extract_all(_c(text), F.lit(r"\{\w+\}"), F.lit(0))


def parse_reasoning(text) -> Column:
    """INS-23: STRUCT<think, answer, well_formed> of ``<think>…</think>
    <answer>…</answer>`` output."""
    t = _c(text)
    think_p = r"(?s)<think>(.*?)</think>"
    answer_p = r"(?s)<answer>(.*?)</answer>"
    ok = t.rlike(r"(?s)^\s*<think>.*?</think>\s*<answer>.*?</answer>\s*$")
    return F.struct(
        F.when(t.rlike(think_p), F.trim(F.regexp_extract(t, think_p, 1))).alias("think"),
        F.when(t.rlike(answer_p), F.trim(F.regexp_extract(t, answer_p, 1))).alias("answer"),
        F.coalesce(ok, F.lit(False)).alias("well_formed"))
