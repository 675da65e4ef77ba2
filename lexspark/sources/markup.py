"""HTML / XML text extraction and court-decision parsing (SRC-02/03/11/12).

These are the only parsers that need Python: each runs per row inside an
Arrow-batched pandas UDF (or ``mapInPandas`` for 1 → N rows) on the
executors, with the standard library only. Everything after the raw text
(cleaning, sections, citations) stays in native Spark columns.
"""

from __future__ import annotations

import html.parser
import xml.etree.ElementTree as ET
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import patterns as P
from ..session import small_batches

_SKIP = frozenset({"script", "style", "template"})
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
         "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _TreeBuilder(html.parser.HTMLParser):
    """Lenient DOM: an end tag closes the nearest open element of that name;
    void elements never take children; script/style/template text is kept
    apart (not visible text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("[document]", {}, None)
        self.cur = self.root
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, dict(attrs), self.cur)
        self.cur.children.append(n)
        if tag not in _VOID:
            self.cur = n
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, dict(attrs), self.cur))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        n = self.cur
        while n.tag != tag:
            self.open[n.tag] -= 1
            n = n.parent
        self.open[tag] -= 1
        self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _parse_html(doc: str) -> _Node:
    b = _TreeBuilder()
    b.feed(doc)
    b.close()
    return b.root


def _walk(node: _Node, skip: frozenset[str] = frozenset()):
    """Everything below a node in document order, texts and elements; those of ``skip`` left out
    with all below them. The way back up is a list, so that depth is no limit."""
    todo = [iter(node.children)]
    while todo:
        ch = next(todo[-1], None)
        if ch is None:
            todo.pop()
        elif isinstance(ch, str):
            yield ch
        elif ch.tag not in skip:
            yield ch
            todo.append(iter(ch.children))


def _strings(node: _Node):
    return (x for x in _walk(node, _SKIP) if isinstance(x, str))


def html_text(doc: str | None) -> str | None:
    """Visible text: every text node stripped, empty ones dropped, joined by
    one space; script/style/template contents and comments excluded."""
    if doc is None:
        return None
    return " ".join(s.strip() for s in _strings(_parse_html(doc)) if s.strip())


def _element_text(el: ET.Element) -> str:
    return " ".join(t for t in map(str.strip, el.itertext()) if t)


def xml_text(doc: str | None) -> str | None:
    """Same text rule for XML (comments and processing instructions dropped)."""
    return None if doc is None else _element_text(ET.fromstring(doc))


def _safe(fn):
    def run(x):
        try:
            return fn(x), None
        except Exception as e:  # noqa: BLE001 — one bad document never stops the batch
            return None, f"{type(e).__name__}: {e}"
    return run


_RESULT = TY.StructType([TY.StructField("value", TY.StringType()), TY.StructField("error", TY.StringType())])


@F.pandas_udf(_RESULT)
def html_to_text_udf(s: pd.Series) -> pd.DataFrame:
    r = [_safe(html_text)(x) for x in s]
    return pd.DataFrame(r, columns=["value", "error"])


@F.pandas_udf(_RESULT)
def xml_to_text_udf(s: pd.Series) -> pd.DataFrame:
    r = [_safe(xml_text)(x) for x in s]
    return pd.DataFrame(r, columns=["value", "error"])


def html_to_text(col) -> "F.Column":
    """SRC-02: STRUCT<value, error>."""
    return html_to_text_udf(F.col(col) if isinstance(col, str) else col)


def xml_to_text(col) -> "F.Column":
    """SRC-03: STRUCT<value, error>."""
    return xml_to_text_udf(F.col(col) if isinstance(col, str) else col)


@F.pandas_udf(_RESULT)
def _markup_udf(s: pd.Series, html: pd.Series) -> pd.DataFrame:
    read = {True: _safe(html_text), False: _safe(xml_text)}
    return pd.DataFrame([read[bool(h)](x) for x, h in zip(s, html)], columns=["value", "error"])


def markup_to_text(col, is_html) -> "F.Column":
    """SRC-02/03 in one pass over rows of both types: STRUCT<value, error>."""
    return _markup_udf(F.col(col) if isinstance(col, str) else col, is_html)


# ---------------------------------------------------------------- decisions

_META = [e for _, e in P.DECISION_META_TAGS]
DECISION_SCHEMA = TY.StructType(
    [TY.StructField(e, TY.StringType()) for e in _META]
    + [TY.StructField("raw_text", TY.StringType()), TY.StructField("error", TY.StringType())])


def _first_elements(root: ET.Element, names: set[str]) -> dict[str, ET.Element]:
    """The first element of each wanted local name (namespaces don't matter), in one walk."""
    found: dict[str, ET.Element] = {}
    for el in root.iter():
        name = el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""
        if name in names:
            found.setdefault(name, el)
    return found


def parse_decision(doc: str | None) -> dict:
    """SRC-11 (Python part): metadata by English name; the text is that of the
    content elements in the order of their list, each followed by a space, or
    all text if those are blank. A document that can't be read has ``error``."""
    record = dict.fromkeys([*_META, "raw_text", "error"])
    if doc is None:
        return record | {"error": "no content"}
    try:
        root = ET.fromstring(doc)
    except ET.ParseError as e:
        return record | {"error": f"ParseError: {e}"}
    names = dict(P.DECISION_META_TAGS)
    found = _first_elements(root, {*names, *P.DECISION_CONTENT_TAGS})
    record |= {names[n]: "".join(el.itertext()).strip() for n, el in found.items() if n in names}
    content = "".join(_element_text(found[n]) + " " for n in P.DECISION_CONTENT_TAGS if n in found)
    return record | {"raw_text": content if content.strip() else _element_text(root)}


@F.pandas_udf(DECISION_SCHEMA)
def _parse_decision_udf(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_decision(x) for x in s], columns=[f.name for f in DECISION_SCHEMA.fields])


def parse_decisions(df: DataFrame, xml_col: str = "xml", source_col: str = "source_file") -> DataFrame:
    """SRC-11: parsed metadata + cleaned full text + German sections without
    fallback (SEC-09); cleaning and sections are native columns."""
    from ..functions import text as T
    from ..operators.preprocess import with_sections

    small_batches(df.sparkSession)
    p = df.select(source_col, _parse_decision_udf(F.col(xml_col)).alias("_d")).select(source_col, "_d.*")
    p = p.withColumn("full_text", T.clean_german("raw_text")).drop("raw_text")
    p = with_sections(p, "full_text", "de", fallback=False)
    drop = ["header", "body", "conclusion"]
    return p.drop(*drop)


# ---------------------------------------------------------------- opinions

OPINION_SCHEMA = "page_id long, ordinal int, title string, text string, date string, error string"


def _elements(node: _Node, tag: str, cls: str | None = None):
    return (x for x in _walk(node) if not isinstance(x, str) and x.tag == tag
            and (cls is None or cls in (x.attrs.get("class") or "").split()))


def opinions(doc: str):
    """``div.opinion`` → (h3 text, div.opinion-text text, span.date text);
    a missing part gives NULL."""
    for div in _elements(_parse_html(doc), "div", "opinion"):
        parts = [next(_elements(div, *q), None) for q in (("h3",), ("div", "opinion-text"), ("span", "date"))]
        yield tuple(None if n is None else "".join(_strings(n)) for n in parts)


def extract_opinions(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """SRC-12: one row per opinion (1 → N rows with ``mapInPandas``); a page
    that can't be parsed gives one row with ``error``."""

    def run(batches):
        for b in batches:
            rows = []
            for pid, doc in zip(b[id_col], b[html_col]):
                found, error = _safe(lambda x: list(opinions(x)))(doc) if doc is not None else ([], None)
                rows.extend((pid, i, *x, None) for i, x in enumerate(found or []))
                if error:
                    rows.append((pid, None, None, None, None, error))
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "title", "text", "date", "error"]).astype({"ordinal": "Int32"})

    return df.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInPandas(run, OPINION_SCHEMA)
