"""Key terms by hand and compounds against all splits."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexspark.operators import vocabulary as V


def test_terms(spark):
    text = "BGH, Urteil; das OLG Köln und LGBT. § 12a Abs. 3 Satz 2 StGB, §§ 5 BGB; Art. 1 GG und § 9 ohne"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    row = df.select(*[V.terms_of(F.col("t"), k).alias(k) for k in V.KINDS]).first()
    assert row["court"] == ["BGH", "OLG"]
    assert row["reference"] == ["§ 12a StGB", "§ 5 BGB", "Art. 1 GG"]
    assert row["word"][:4] == ["bgh", "urteil", "das", "olg"]


def test_keyness(spark):
    rows = [(1, "BGH BGH x", True), (2, "BGH y z", True), (3, "BGH a b c", False), (4, None, True), (5, "OLG", None)]
    df = spark.createDataFrame(rows, "id int, t string, dom boolean")
    got = V.key_terms(df, "id", "t", F.col("dom"), "court").collect()
    a, b, na, nb = 3, 1, 6, 5
    want = 2 * (a * math.log(a / (na * 4 / 11)) + b * math.log(b / (nb * 4 / 11)))
    assert [(r["term"], r["term_freq"], r["doc_freq"], r["background_freq"]) for r in got] == [("BGH", 3, 2, 1)]
    assert got[0]["keyness"] == pytest.approx(want, abs=1e-6)
    assert V.key_terms(df.limit(0), "id", "t", F.col("dom"), "court").collect() == []


def test_counts_of_rows_that_share_an_id(spark, monkeypatch):
    """Words are counted where they are found, not exploded into a row each; ids that repeat, null too, are one document (F8, F11)."""
    monkeypatch.setattr(V, "HELD", 5)
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40), *range(40, 400)]), " ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 12))), rng.choice([True, False, None]))
            for _ in range(300)] + [(7, None, True)]
    df = spark.createDataFrame(rows, "id int, t string, dom boolean")
    freq, back, docs, totals = Counter(), Counter(), set(), Counter()
    for i, t, dom in rows:
        words = (t or "").split()
        (freq if dom else back).update(words)
        totals[bool(dom)] += len(words)
        docs |= {(w, i) for w in words if dom}
    got = {r["term"]: tuple(r)[1:] for r in V.term_counts(df, "id", "t", F.col("dom"), "word").collect()}
    total = got.pop(None)
    assert got == {w: (freq[w], sum(x == w for x, _ in docs), back[w]) for w in freq | back}
    assert (total[0], total[2]) == (totals[True], totals[False])
    plan = V.term_counts(df, "id", "t", F.col("dom"), "word")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_words_of_plain_and_other_texts(spark):
    """Texts in Latin letters and punctuation are counted in Python as Spark counts the others."""
    alphabet = "".join(map(chr, range(1, 0x250))) + "\u2000\u201e\u2013\u2069"
    texts = [*alphabet, *(f"xa{c}Yb" for c in alphabet), "ÄÖÜẞ ß İI ıi", "Ω дом 中文 ⅷ²", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["term"]: r["term_freq"] for r in V.term_counts(df, "id", "t", F.lit(True), "word").collect()}
    t = F.coalesce("t", F.lit(""))
    rows = df.select(V.terms_of(t, "word").alias("w"), F.size(F.regexp_extract_all(t, F.lit(V.TOKEN), F.lit(0))).alias("n")).collect()
    assert got == {**Counter(w for r in rows for w in r["w"]), None: sum(r["n"] for r in rows)}


def plain_compounds(n, min_part, least, longest, most):
    out = {}
    for word, own in n.items():
        if not 2 * min_part <= len(word) <= longest:
            continue
        best = None
        for k in range(2, most + 1):
            for cuts in itertools.combinations(range(min_part, len(word) - min_part + 1), k - 1):
                at = [0, *cuts, len(word)]
                parts = []
                for i, j in zip(at, at[1:]):
                    x = word[i:j]
                    forms = [x] + [x[:-len(e)] for e in V.LINKS if j < len(word) and x.endswith(e)]
                    forms = [f for f in forms if len(f) >= min_part and n.get(f, 0) >= least]
                    if not forms or j - i < min_part:
                        break
                    parts.append(max(forms, key=lambda f: (n[f], len(f), f)))
                else:
                    found = (-sum(round(math.log(n[p]) * 1e6) for p in parts) * 60 // k, k, " + ".join(parts))
                    best = min(best or found, found)
        if best and -best[0] > round(math.log(own) * 1e6) * 60:
            out[word] = (best[2], -best[0] / 60e6)
    return out


def test_compounds_against_all_splits(spark):
    rng = random.Random(4)
    stems = ["recht", "staat", "anwalt", "gericht", "urteil", "amts", "land", "verfassung", "straf", "kammer", "ord", "nung"]
    words = Counter()
    for _ in range(4000):
        k = rng.choice([1, 1, 1, 2, 2, 3, 4])
        words["".join(rng.choice(stems) + (rng.choice(["", "s", "es", "n"]) if i < k - 1 else "") for i in range(k))] += 1
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["parts"], r["score"]) for r in V.compounds(df, 4, 3, 40, 3).collect()}
    want = plain_compounds(words, 4, 3, 40, 3)
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(got[w][0] == want[w][0] and got[w][1] == pytest.approx(want[w][1], abs=1e-9) for w in want)
    assert got["verfassungsgericht"][0] == "verfassung + gericht"
    assert V.compounds(df.limit(0)).collect() == []
