"""Driver queries for the domain vocabulary (AGG-09): the German half of the ``legal`` view against the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vocabulary as V
from . import sql_re2 as R
from .legal import legal, with_legal
from .registry import query

q = R.q


def _terms_sql(kind: str) -> str:
    t = "coalesce(text, '')"
    if kind == "court":
        return f"list_filter(regexp_extract_all({t}, {q(V.TOKEN)}), lambda x: x IN ({', '.join(map(q, V.COURTS))}))"
    if kind == "reference":
        return (f"list_transform(regexp_extract_all({t}, {q(V.REFERENCE)}), lambda x: concat(CASE WHEN starts_with(x, '§') THEN '§ ' ELSE 'Art. ' END, "
                f"regexp_extract(x, {q(V.REFERENCE)}, 1), ' ', regexp_extract(x, {q(V.REFERENCE)}, 2)))")
    return f"regexp_extract_all(lower({t}), {q(V.WORD)})"


def _keyness_sql(kind: str) -> str:
    """CTEs up to ``key``: the domain's terms with counts and keyness."""
    return (f"o AS (SELECT language = 'de' AS dom, doc_id, unnest({_terms_sql(kind)}) AS term FROM legal), "
            "c AS (SELECT term, CAST(count(*) FILTER (WHERE dom) AS BIGINT) AS term_freq, CAST(count(DISTINCT doc_id) FILTER (WHERE dom) AS BIGINT) AS doc_freq, "
            "CAST(count(*) FILTER (WHERE NOT dom) AS BIGINT) AS background_freq FROM o GROUP BY term), "
            f"z AS (SELECT CAST(sum(CASE WHEN language = 'de' THEN n END) AS DOUBLE) AS na, CAST(sum(CASE WHEN language <> 'de' THEN n END) AS DOUBLE) AS nb "
            f"FROM (SELECT language, len(regexp_extract_all(coalesce(text, ''), {q(V.TOKEN)})) AS n FROM legal)), "
            "e AS (SELECT c.*, na, nb, (CAST(term_freq AS DOUBLE) + background_freq) / (na + nb) AS both_f FROM c, z WHERE term_freq > 0), "
            "g AS (SELECT *, 2 * (term_freq * ln(term_freq / (na * both_f)) + CASE WHEN background_freq > 0 THEN background_freq * ln(background_freq / (nb * both_f)) ELSE 0.0 END) AS ratio FROM e), "
            "key AS (SELECT term, term_freq, doc_freq, background_freq, round(CASE WHEN term_freq * nb < background_freq * na THEN -ratio ELSE ratio END, 6) AS keyness FROM g)")


_TOP = "ORDER BY keyness DESC, term_freq DESC, term LIMIT 5000"


def _class_sql(kind: str) -> str:
    return with_legal(f", {_keyness_sql(kind)} SELECT * FROM key {_TOP}")


def _class(kind):
    def run(spark, sf_dir):
        return V.key_terms(legal(spark, sf_dir), "doc_id", "text", F.col("language") == "de", kind, 5000)

    return run


query("vocabulary_courts", _class_sql("court"))(_class("court"))
query("vocabulary_references", _class_sql("reference"))(_class("reference"))
query("vocabulary_words", _class_sql("word"))(_class("word"))


def _compound_sql() -> str:
    forms = ["x", *[f"CASE WHEN j < size AND x LIKE '%{e}' AND length(x) >= {V.MIN_PART + len(e)} THEN substr(x, 1, length(x) - {len(e)}) END" for e in V.LINKS]]
    steps = ["p1 AS (SELECT word, size, j AS pos, CAST(round(ln(n) * 1e6) AS BIGINT) AS score, part AS parts FROM edges WHERE i = 0)"]
    for k in range(2, V.MOST_PARTS + 1):
        steps.append(f"p{k} AS (SELECT word, size, j AS pos, score, parts FROM (SELECT p.word, p.size, e.j, p.score + CAST(round(ln(e.n) * 1e6) AS BIGINT) AS score, concat(p.parts, ' + ', e.part) AS parts "
                     f"FROM p{k - 1} p JOIN edges e ON e.word = p.word AND e.i = p.pos WHERE p.pos < p.size) QUALIFY row_number() OVER (PARTITION BY word, j ORDER BY score DESC, parts) = 1)")
    done = " UNION ALL ".join(f"SELECT word, score * {12 // k} AS score, {k} AS k, parts FROM p{k} WHERE pos = size" for k in range(2, V.MOST_PARTS + 1))
    return with_legal(
        f", {_keyness_sql('word')}, spans AS (SELECT *, substr(word, i + 1, j - i) AS x FROM (SELECT *, unnest(range(i + {V.MIN_PART}, size + 1)) AS j FROM "
        f"(SELECT term AS word, length(term) AS size, unnest(range(0, length(term) - {V.MIN_PART} + 1)) AS i FROM key WHERE length(term) BETWEEN {2 * V.MIN_PART} AND {V.LONGEST})) "
        "WHERE NOT (i = 0 AND j = size)), "
        f"forms AS (SELECT word, size, i, j, unnest([{', '.join(forms)}]) AS part FROM spans), "
        f"edges AS (SELECT f.word, f.size, f.i, f.j, f.part, k.term_freq AS n FROM forms f JOIN key k ON k.term = f.part WHERE length(f.part) >= {V.MIN_PART} AND k.term_freq >= {V.LEAST_COUNT} "
        "QUALIFY row_number() OVER (PARTITION BY f.word, f.i, f.j ORDER BY k.term_freq DESC, length(f.part) DESC, f.part DESC) = 1), "
        f"{', '.join(steps)}, whole AS (SELECT * FROM ({done}) QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, k, parts) = 1) "
        f"SELECT key.*, parts, score / 12e6 AS score FROM key JOIN whole ON word = term WHERE score > CAST(round(ln(term_freq) * 1e6) AS BIGINT) * 12 {_TOP}")


@query("vocabulary_compounds", _compound_sql())
def vocabulary_compounds(spark, sf_dir):
    return V.key_compounds(legal(spark, sf_dir), "doc_id", "text", F.col("language") == "de", 5000)
