"""Licence scan by a positional index of rare licence words, in native expressions only.

A template is the text of a licence notice with a mandatory key phrase. Words weigh by their inverse
document frequency in the scanned files. A file's licence words are looked up: a template comes into
question if the file has the rarest words of its key phrase; the places of those words, less their
positions in the phrase, are intersected, and the whole phrase is verified at what is left. The score
is the largest share of a template's words that stand where the template has them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2  # rarest words of a key phrase whose places are intersected


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # mandatory, a run of the text's words
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase(self) -> list[str]:
        return self.key.split()

    @property
    def start(self) -> int:
        """Where the key phrase stands in the text."""
        n = len(self.phrase)
        return next(i for i in range(len(self.words)) if self.words[i:i + n] == self.phrase)


#: Wording of common licence notices, and the four base phrases.
TEMPLATES = [
    Template("gpl", "this work is licensed under the gnu general public license", "gnu general public license", True),
    Template("apache", "licensed under the apache license", "apache license", True),
    Template("cc-by", "this work is licensed under cc by", "cc by", True),
    Template("mit", "released under the mit license", "mit license", True),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             "with or without fee is hereby granted"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]


def words(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and all other characters beyond ASCII.

    ``lower`` also changes letters beyond ASCII; that moves no word's edges and makes no ASCII word
    but from the Kelvin sign, and no key phrase has a k.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _lit(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _anchors(t: Template, idf: dict[str, float]) -> list[str]:
    return sorted(set(t.phrase), key=lambda w: (-idf[w], w))[:ANCHORS]


def document_frequencies(tokenised: DataFrame, templates: list[Template]) -> tuple[int, dict[str, int]]:
    """Files, and files with each word of a key phrase: one row per licence word."""
    rows = (tokenised.select(F.explode("licence_words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect())
    return tokenised.count(), dict.fromkeys((w for t in templates for w in t.phrase), 0) | dict(rows)


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (the smallest and largest start, words from 0; else null), base_labels, labels
    (distinct, sorted, comma-joined, empty if none), score (0 to 1).

    Null and empty texts have no words, labels or places and score 0; repeated rows and null ids
    have rows of their own; an empty table stays empty; further columns are ignored. Whole texts
    are scanned, and all places of a phrase count.
    """
    vocabulary = sorted({w for t in templates for w in t.phrase})
    listed = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    # texts are cut into words once: both looks at them read the words
    with_words = written(listed.select("doc_id", "words", F.array_intersect("words", _lit(vocabulary)).alias("licence_words")), "words")
    n, df = document_frequencies(with_words.select("licence_words"), templates)
    idf = {w: math.log((n + 1) / (k + 1)) for w, k in df.items()}

    anchors = {t.label: _anchors(t, idf) for t in templates}
    rare = sorted({w for a in anchors.values() for w in a})
    # places of the rare words, only where a template's anchors are all there
    asked = F.lit(False)
    for a in {tuple(x) for x in anchors.values()}:
        asked = asked | (F.size(F.array_intersect("licence_words", _lit(list(a)))) == len(a))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), lambda s: s.isNotNull())
    located = with_words.withColumn("places", F.when(asked, places))
    # once per row: the lists below look at these few places, not at the words again
    found = located.withColumns({f"_{k}": _starts(t, anchors[t.label]) for k, t in enumerate(templates)})
    base = [F.col(f"_{k}") for k, t in enumerate(templates) if t.base]
    starts = F.concat(*base)

    def joined(which) -> Column:
        names = [F.when(F.size(f"_{k}") > 0, F.lit(t.label)) for k, t in sorted(enumerate(templates), key=lambda x: x[1].label) if which(t)]
        return F.concat_ws(",", *names)

    return found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(lambda t: t.base).alias("base_labels"), joined(lambda t: True).alias("labels"),
        F.greatest(*[_coverage(t, F.col(f"_{k}")) for k, t in enumerate(templates)]).alias("score"))


def _starts(t: Template, anchors: list[str]) -> Column:
    """Where the key phrase starts: places of each anchor less its positions in the phrase,
    intersected, then verified on the phrase's words; an empty list for files without places."""
    common = None
    for w in anchors:
        own = F.transform(F.filter("places", lambda s: s["w"] == w), lambda s: s["i"])
        at = [p for p, x in enumerate(t.phrase) if x == w]
        shifted = F.flatten(F.array(*[F.transform(own, lambda i, p=p: i - p) for p in at])) if len(at) > 1 else F.transform(own, lambda i: i - at[0])
        common = F.array_distinct(shifted) if common is None else F.array_intersect(common, shifted)
    phrase = _lit(t.phrase)
    verified = F.filter(common, lambda i: (i >= 0) & (F.slice(F.col("words"), F.greatest(i, F.lit(0)) + 1, F.lit(len(t.phrase))) == phrase))
    return F.coalesce(verified, F.array().cast("array<int>"))


def _coverage(t: Template, starts: Column) -> Column:
    """The largest share of the template's words in place, over the starts of its key phrase."""
    def share(i: Column) -> Column:
        hits = [F.when(F.get(F.col("words"), i + (j - t.start)) == w, F.lit(1)).otherwise(F.lit(0)) for j, w in enumerate(t.words)]
        return sum(hits[1:], hits[0]).cast("double") / F.lit(float(len(t.words)))

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def oracle_sql(templates: list[Template] = TEMPLATES) -> str:
    """The same result in DuckDB SQL, by looking for the phrases at every word."""
    def listed(ws: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in ws) + "]"

    starts = ",\n  ".join(
        f"list_filter(range(len(w) - {len(t.phrase) - 1}), lambda i: w[i + 1] = '{t.phrase[0]}' AND w[i + 1:i + {len(t.phrase)}] = {listed(t.phrase)}) AS s{k}"
        for k, t in enumerate(templates))
    scores = ",\n  ".join(
        f"coalesce(list_max(list_transform(s{k}, lambda i: CAST(list_sum(list_transform(range({len(t.words)}), lambda j: CASE WHEN i + j - {t.start} >= 0 "
        f"AND w[i + j - {t.start} + 1] = {listed(t.words)}[j + 1] THEN 1 ELSE 0 END)) AS DOUBLE) / {len(t.words)})), 0)"
        for k, t in enumerate(templates))
    base = [k for k, t in enumerate(templates) if t.base]

    def joined(ks) -> str:
        return "concat_ws(','," + ", ".join(f"CASE WHEN len(s{k}) > 0 THEN '{templates[k].label}' END" for k in sorted(ks, key=lambda k: templates[k].label)) + ")"

    places = " || ".join(f"s{k}" for k in base)
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
u AS (SELECT doc_id, w, {starts} FROM t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({places}) AS BIGINT) AS n_base,
  CAST(list_min({places}) AS BIGINT) AS first_word, CAST(list_max({places}) AS BIGINT) AS last_word,
  {joined(base)} AS base_labels, {joined(range(len(templates)))} AS labels,
  greatest({scores}) AS score
FROM u"""
