"""Porter stemmer (Porter 1980, with the common extensions: irregular-form
pool, short-word guard, 'ies'/'ied' on four-letter words, y→i only after a
consonant that is not the first letter, bli/logi/fulli/lessli rules) for
ROUGE's tokenizer.

Each step is a projection over a table of distinct words: the word, its
letters as consonants and vowels (``cv``), and the suffix the step looks
for. The step texts are plain SQL of functions that all engines share, so
the same rules can be run elsewhere as a check. ``stem_tokens`` stems the
distinct vocabulary once and joins the stems back to the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_join

# fixed values: irregular forms kept or mapped as a whole
_POOL = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
         "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
         "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
         "exceed": "exceed", "succeed": "succeed"}
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful"), ("lessli", "less"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
          "ate", "iti", "ous", "ive", "ize"]

#: words of fewer letters stay, as in ROUGE's tokenizer
SHORTEST = 4
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _cv() -> str:
    """Consonants as c, vowels as v; a y is a consonant at the front and after a vowel."""
    x = f"translate(w, '{_LETTERS}', '{''.join('v' if a in 'aeiou' else 'y' if a == 'y' else 'c' for a in _LETTERS)}')"
    x = f"concat(CASE WHEN w LIKE 'y%' THEN 'c' ELSE substring({x}, 1, 1) END, substring({x}, 2))"
    for _ in range(4):  # each round settles two letters of a run of y
        x = f"replace(replace({x}, 'vy', 'vc'), 'cy', 'cv')"
    return x


def _cut(k) -> str:
    return f"substring(w, 1, length(w) - {k})"


def _m(k) -> str:
    """Vowel-consonant sequences of the word without its last ``k`` letters."""
    head = f"substring(cv, 1, length(w) - {k})"
    return f"(length({head}) - length(replace({head}, 'vc', '')))"  # two letters each


def _short(k) -> str:
    """Without its last ``k`` letters the word ends consonant, vowel, consonant other than w, x, y."""
    head = f"substring(cv, 1, length(w) - {k})"
    return f"(({head} LIKE '%cvc' OR {head} = 'vc') AND substring(w, length(w) - {k}, 1) NOT IN ('w', 'x', 'y'))"


def _suffix(rules) -> str:
    """The longest of the suffixes: a match from the left is the longest one at the end."""
    return f"regexp_extract(w, '({'|'.join(rules)})$', 1)"


def _mapped(rules) -> str:
    to = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules)
    return f"CASE WHEN s <> '' AND {_m('length(s)')} > 0 THEN concat({_cut('length(s)')}, CASE s {to} END) ELSE w END"


def _after_ending() -> str:
    """Step 1b behind -ed and -ing (``s``)."""
    k = "length(s)"
    last, before = f"substring(w, length(w) - {k}, 1)", f"substring(w, length(w) - {k} - 1, 1)"
    head = f"substring(cv, 1, length(w) - {k})"
    return (f"CASE WHEN {head} NOT LIKE '%v%' THEN w WHEN {_cut(k)} LIKE '%at' OR {_cut(k)} LIKE '%bl' OR {_cut(k)} LIKE '%iz' THEN concat({_cut(k)}, 'e') "
            f"WHEN length(w) - {k} >= 2 AND {last} = {before} AND {head} LIKE '%c' THEN CASE WHEN {last} IN ('l', 's', 'z') THEN {_cut(k)} ELSE {_cut(f'({k} + 1)')} END "
            f"WHEN {_m(k)} = 2 AND {_short(k)} THEN concat({_cut(k)}, 'e') ELSE {_cut(k)} END")


def steps() -> list[tuple[str, str]]:
    """(suffix looked for, new word) of each step, as SQL over ``w``, ``cv`` and, in the second, ``s``."""
    return [
        ("''", f"CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN {_cut(1)} WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut(2)} "
               f"WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {_cut(1)} ELSE w END"),
        (_suffix(["ied", "eed", "ed", "ing"]),
         f"CASE s WHEN '' THEN w WHEN 'ied' THEN CASE WHEN length(w) = 4 THEN {_cut(1)} ELSE {_cut(2)} END "
         f"WHEN 'eed' THEN CASE WHEN {_m(3)} > 0 THEN {_cut(1)} ELSE w END ELSE {_after_ending()} END"),
        ("''", f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND cv LIKE '%c_' THEN concat({_cut(1)}, 'i') ELSE w END"),
        ("''", f"CASE WHEN w LIKE '%alli' AND {_m(4)} > 0 THEN {_cut(2)} ELSE w END"),
        (_suffix([a for a, _ in _STEP2]), _mapped(_STEP2)),
        (_suffix([a for a, _ in _STEP3]), _mapped(_STEP3)),
        (_suffix(_STEP4), f"CASE WHEN s = '' OR {_m('length(s)')} <= 2 OR (s = 'ion' AND substring(w, length(w) - 3, 1) NOT IN ('s', 't')) THEN w ELSE {_cut('length(s)')} END"),
        ("''", f"CASE WHEN w LIKE '%e' AND ({_m(1)} > 2 OR ({_m(1)} = 2 AND NOT {_short(1)})) THEN {_cut(1)} ELSE w END"),
        ("''", f"CASE WHEN w LIKE '%ll' AND {_m(1)} > 2 THEN {_cut(1)} ELSE w END"),
    ]


def irregular() -> str:
    """The stem of an irregular form, else null."""
    return "CASE word " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _POOL.items()) + " END"


def stems(words: DataFrame) -> DataFrame:
    """(word, stem) for every row of ``words`` (column ``word``: lower-case ASCII letters and digits)."""
    out = words.select("word", F.col("word").alias("w"))
    for suffix, new in steps():
        out = out.select("word", "w", F.expr(_cv()).alias("cv")).select("*", F.expr(suffix).alias("s")).select("word", F.expr(new).alias("w"))
    stem = F.coalesce(F.expr(irregular()), F.when(F.length("word") < SHORTEST, F.col("word")).otherwise(F.col("w")))
    # a generated column: a condition on the stem is not traced back through all steps
    return out.select("word", F.explode(F.array(stem)).alias("stem"))


def stem_tokens(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Replace columns of tokens by their stems (tokens of ``SHORTEST`` letters or more, as in ROUGE's
    tokenizer). Usable as the ``stemmer`` hook of the ROUGE scorers. ``keys`` (default: the first
    column) identify a row.

    Tokens are dealt out with their places, the distinct ones are stemmed once, and the stems are
    joined back; a token that is in many texts is dealt to several tasks. A row's tokens come
    together again by its key. Rows with null or empty token lists keep them empty.
    """
    keys = keys or df.columns[:1]
    others = [c for c in df.columns if c not in cols and c not in keys]

    def placed(k: int) -> Column:
        return F.transform(F.coalesce(cols[k], F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(k).alias("c"), i.alias("i"), t.alias("word")))

    def own(k: int) -> Column:
        return F.transform(F.filter("_s", lambda x: x["c"] == k), lambda x: x["w"])

    rows = df.select(*keys, F.struct(F.lit(0).alias("_"), *others).alias("_o"), F.posexplode_outer(F.concat(*map(placed, range(len(cols))))).alias("_at", "_t"))
    tokens = rows.select(*keys, F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_o")).alias("_o"), "_t.c", "_t.i", "_t.word")  # the rest goes with a row's first token
    dictionary = stems(tokens.filter(F.length("word") >= SHORTEST).select("word").distinct()).filter("stem <> word")
    stemmed = salted_join(tokens, dictionary, "word", [*keys, "c", "i"], "left")
    out = stemmed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("c", "i", F.coalesce("stem", "word").alias("w")))).alias("_s"), F.first("_o", ignorenulls=True).alias("_o"))
    return out.select(*keys, *[F.col(f"_o.{c}").alias(c) for c in others], *[own(k).alias(c) for k, c in enumerate(cols)]).select(*df.columns)
