"""Oracle-side (DuckDB / RE2) spellings of the fixed patterns.

RE2 has no lookahead and no atomic groups: ``K.*?(?=E|$)`` becomes
``(K.*?)(?:E|$)`` with group 1, and the court citations use the plain lazy
form (RE2 runs it in linear time). Flags: ``(?s)`` + ``(?i)``; RE2 folds case
Unicode-aware by default.
"""

from ..functions import patterns as P

WS = P.WS
NON_ASCII_RUN = P.NON_ASCII_RUN

SECTIONS_EN = [
    ("header", r"(?si)^(.*?)(?:OPINION|DECISION)"),
    ("body", r"(?si)(?:OPINION|DECISION)(.*?)(?:CONCLUSION|$)"),
    ("conclusion", r"(?si)(?:CONCLUSION|ORDER)(.*?)$"),
]
SECTIONS_DE = [
    ("tatbestand", r"(?si)((?:Tatbestand|TATBESTAND).*?)(?:Entscheidungsgründe|ENTSCHEIDUNGSGRÜNDE|II\.|$)"),
    ("gruende", r"(?si)((?:Entscheidungsgründe|ENTSCHEIDUNGSGRÜNDE|Gründe|GRÜNDE).*?)(?:III\.|$)"),
    ("tenor", r"(?si)((?:Tenor|TENOR|Beschluss|BESCHLUSS).*?)(?:Tatbestand|TATBESTAND|I\.|$)"),
    ("leitsaetze", r"(?si)((?:Leitsätze|LEITSÄTZE|Leitsatz|LEITSATZ).*?)(?:Tenor|TENOR|$)"),
]
CITATIONS_EN = P.CITATIONS_EN
CITATIONS_DE = [
    r"BGH.*?(?:Urteil|Beschluss).*?vom.*?\d{1,2}\.\d{1,2}\.\d{4}",
    r"BVerfG.*?(?:Urteil|Beschluss).*?vom.*?\d{1,2}\.\d{1,2}\.\d{4}",
    P.CITATIONS_DE[2],
    P.CITATIONS_DE[3],
]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def normalize_sql(text: str, lang: str) -> str:
    """lang: SQL expression or quoted literal."""
    c = f"regexp_replace({text}, {q(WS)}, ' ', 'g')"
    en = f"regexp_replace({c}, {q(NON_ASCII_RUN)}, ' ', 'g')"
    de = f"replace({c}, '„', '\"')"
    return f"trim(CASE WHEN {lang} = 'en' THEN {en} WHEN {lang} = 'de' THEN {de} ELSE {c} END)"


def clean_german_sql(text: str) -> str:
    c = f"regexp_replace({text}, {q(WS)}, ' ', 'g')"
    c = f"regexp_replace({c}, {q(r'^\s*\d+\s*')}, '')"
    return f"trim(replace({c}, '„', '\"'))"


def first_group_sql(text: str, pattern: str) -> str:
    return (f"CASE WHEN regexp_matches({text}, {q(pattern)}) "
            f"THEN trim(regexp_extract({text}, {q(pattern)}, 1)) END")


def citations_sql(text: str, lang: str) -> str:
    def all_of(pats):
        parts = [f"regexp_extract_all({text}, {q(p)}, 0)" for p in pats]
        out = parts[0]
        for p in parts[1:]:
            out = f"list_concat({out}, {p})"
        return out

    return (f"CASE WHEN {lang} = 'en' THEN {all_of(CITATIONS_EN)} "
            f"WHEN {lang} = 'de' THEN {all_of(CITATIONS_DE)} ELSE []::VARCHAR[] END")


def anonymize_sql(text: str, lang: str) -> str:
    def chain(rules):
        c = text
        for _, p, r in rules:
            c = f"regexp_replace({c}, {q(p)}, {q(r)}, 'g')"
        return c

    return (f"CASE WHEN {lang} = 'en' THEN {chain(P.ANON_EN)} "
            f"WHEN {lang} = 'de' THEN {chain(P.ANON_DE)} ELSE {text} END")
