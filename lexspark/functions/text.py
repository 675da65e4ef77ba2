"""Column functions for legal text: normalise, sections, citations, masking.

All of them are native Spark expressions (regexes run in the JVM inside
whole-stage codegen); none needs a Python worker. ``lang`` is either a
Python string (the branch is chosen at plan time) or a Column (one CASE per
row, for mixed-language tables).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_lang(lang, en: Column, de: Column, other: Column) -> Column:
    if isinstance(lang, str):
        return {"en": en, "de": de}.get(lang, other)
    return F.when(lang == "en", en).when(lang == "de", de).otherwise(other)


def collapse_ws(text) -> Column:
    """Every run of (Python) whitespace → one space."""
    return F.regexp_replace(_col(text), P.WS, " ")


def normalize(text, lang="en") -> Column:
    """TXT-01..03. EN: collapse, each non-ASCII run → one space, trim (no
    re-collapse). DE: collapse, „ → ", trim. Other: collapse, trim.
    Valid UTF-8 is guaranteed for Spark strings read from Parquet; invalid
    bytes from binary sources are dropped by ``make_valid_utf8`` there."""
    c = collapse_ws(text)
    return F.trim(_by_lang(lang,
                           en=F.regexp_replace(c, P.NON_ASCII_RUN, " "),
                           de=F.translate(c, P.LOW_DOUBLE_QUOTE, '"'),
                           other=c))


def clean_german(text) -> Column:
    """TXT-04: collapse whitespace, drop one leading number (the multiline
    flag is moot after the collapse), „ → ", trim."""
    c = collapse_ws(text)
    c = F.regexp_replace(c, r"^\s*\d+\s*", "")
    return F.trim(F.translate(c, P.LOW_DOUBLE_QUOTE, '"'))


def normalize_flags(text, lowercase=False, remove_accents=False, strip=True) -> Column:
    """TXT-05: optional lower-case / accent removal / trim."""
    c = _col(text)
    if lowercase:
        c = F.lower(c)
    if remove_accents:
        src = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿÇçÑñ"
        dst = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuYyyCcNn"
        c = F.translate(c, src, dst)
    if strip:
        c = F.trim(c)
    return c


_LOCAL = "[a-zA-Z0-9._%+-]"


def linear(pattern: str) -> str:
    """A form of a citation or masking pattern with the same matches in linear time: a run is
    entered where it begins (or where the last match ended), not again at each of its characters."""
    if pattern.startswith(r"\d+"):  # no match ends within a run of digits
        return r"(?<!\d)\d++" + pattern[3:]
    if pattern == P.EMAIL:
        return rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++" + pattern[len(_LOCAL) + 1:]
    return pattern


def _all_matches(text: Column, pattern: str) -> Column:
    court = pattern.split("(")[0]
    if court not in ("BGH", "BVerfG"):
        return F.regexp_extract_all(text, F.lit(linear(pattern)), F.lit(0))
    # where no citation follows a court's name, none follows a later one on the line: skip the rest of it
    found = F.regexp_extract_all(text, F.lit(f"({pattern})|{court}.*"), F.lit(1))
    return F.filter(found, lambda x: x != "")


def _first_group(text: Column, pattern: str, group: int) -> Column:
    """First match's group, NULL when the pattern does not match (an empty
    group of a real match stays '')."""
    if group == 0:
        # group 0 always contains the keyword, so '' can only mean no match
        return F.regexp_substr(text, F.lit(pattern))
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def citations(text, lang="en") -> Column:
    """CIT-01..09: matches concatenated pattern by pattern, then by position;
    duplicates kept. Languages other than en/de → empty array."""
    t = _col(text)

    def all_of(pats):
        return F.concat(*[_all_matches(t, p) for p in pats])

    empty = F.when(t.isNotNull(), F.array().cast("array<string>"))
    return _by_lang(lang, en=all_of(P.CITATIONS_EN), de=all_of(P.CITATIONS_DE), other=empty)


# Literals every match of a masking rule contains: hit counting runs a
# rule's regex only on texts that contain one (same counts, less regex work).
_GUARDS = {
    "name_mr": ["Mr."], "name_ms": ["Ms."], "name_mrs": ["Mrs."],
    "address": ["Street", "Avenue", "Road", "Blvd", "straße", "weg", "allee", "platz"],
    "phone_paren": ["("], "phone_dash": ["-"], "email": ["@"],
    "name_herr": ["Herr"], "name_frau": ["Frau"], "phone": ["0"],
}


def _guarded(t: Column, name: str, apply: Column, otherwise: Column) -> Column:
    lits = _GUARDS.get(name)
    if not lits:
        return apply
    cond = t.contains(lits[0])
    for x in lits[1:]:
        cond = cond | t.contains(x)
    return F.when(cond, apply).otherwise(otherwise)


def anonymize(text, lang="en") -> Column:
    """ANO-01..13: masking rules in order; other languages unchanged."""
    t = _col(text)

    def chain(rules):
        c = t
        for _, pat, rep in rules:
            c = F.regexp_replace(c, linear(pat), rep)
        return c

    return _by_lang(lang, en=chain(P.ANON_EN), de=chain(P.ANON_DE), other=t)


def pii_counts(text, lang="en") -> Column:
    """ANO-14: STRUCT of hit counts per masking rule (rule names are shared
    by both languages where they mean the same thing)."""
    t = _col(text)
    names = []
    for n, _, _ in P.ANON_EN + P.ANON_DE:
        if n not in names:
            names.append(n)
    en = dict((n, p) for n, p, _ in P.ANON_EN)
    de = dict((n, p) for n, p, _ in P.ANON_DE)
    fields = []
    for n in names:
        e = _guarded(t, n, F.regexp_count(t, F.lit(linear(en[n]))), F.lit(0)) if n in en else F.lit(0)
        d = _guarded(t, n, F.regexp_count(t, F.lit(linear(de[n]))), F.lit(0)) if n in de else F.lit(0)
        fields.append(_by_lang(lang, en=e, de=d, other=F.lit(0)).cast("bigint").alias(n))
    return F.struct(*fields)


def truncate_text(text, max_chars: int = P.MAX_CHARS_DE, suffix: str = "...") -> Column:
    """PRJ-04/05: cut to ``max_chars`` code points, append ``...`` only when longer."""
    t = _col(text)
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(suffix))).otherwise(t)


def path_key(col) -> Column:
    """SNK-11: ``/`` → ``_``."""
    return F.translate(_col(col), "/", "_")


def standardize_citation(col) -> Column:
    """CIT-11 (our definition): collapse spaces, Absatz → Abs., Satz → S.,
    exactly one space after § and Art."""
    c = F.regexp_replace(_col(col), r"\s+", " ")
    c = F.regexp_replace(c, r"\bAbsatz\b", "Abs.")
    c = F.regexp_replace(c, r"\bSatz\b", "S.")
    c = F.regexp_replace(c, r"§ ?", "§ ")
    c = F.regexp_replace(c, r"Art\. ?", "Art. ")
    return F.trim(c)


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing (Unicode) whitespace."""
    ws = P.WS[:-1]  # the class without the trailing '+'
    return F.regexp_replace(_col(col), f"^{ws}+|(?<!{ws}){ws}+$", "")
