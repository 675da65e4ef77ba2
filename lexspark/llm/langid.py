"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1. An n-gram of three letters is the element-wise product
of its letters' vectors, the first rolled by two places and the second by one (bind permuted), a
text the sum of its n-grams' vectors (bundle), a language the sum over the texts learned. A text
takes the language whose profile has the largest cosine with its own.

Letters are those of ``str.isalpha`` after ``str.lower``; words are runs of letters, with a mark
at either end. Letters up to U+017F have vectors of their own; later ones share 640, by code point
modulo 640, so that the table stays small while neighbours in a script differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, from_row, small_batches

DIM = 1024
SEED = 7
_DIRECT, _SHARED = 0x180, 640
_BITS = 10  # of a letter's number in an n-gram's code
_FLUSH = 1 << 18  # n-grams a task holds before it hands their counts on


@cache
def _letters() -> np.ndarray:
    """Code point -> number of its letter, 0 for everything else."""
    cp = np.arange(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.where(cp < _DIRECT, cp, _DIRECT + cp % _SHARED), 0).astype(np.int32)


@cache
def _vectors(dim: int, seed: int) -> tuple[np.ndarray, ...]:
    """Random vectors of all letters, as the first, second and third of an n-gram."""
    v = np.random.default_rng(seed).integers(0, 2, (1 << _BITS, dim), dtype=np.int8) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams and how often each occurs; empty without letters."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate(([0], _letters()[cp], [0]))
    s = s[(s != 0) | np.concatenate(([True], s[:-1] != 0))]  # runs of other characters are one mark
    code = (s[:-2].astype(np.int64) << 2 * _BITS) | (s[1:-1].astype(np.int64) << _BITS) | s[2:]
    return np.unique(code[s[1:-1] != 0], return_counts=True)


def gram_vectors(codes: np.ndarray, dim: int, seed: int) -> np.ndarray:
    first, second, third = _vectors(dim, seed)
    low = (1 << _BITS) - 1
    return first[codes >> 2 * _BITS] * second[(codes >> _BITS) & low] * third[codes & low]


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def out():
        for lang, parts in held.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": n})

    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            codes, n = grams(text)
            if len(codes):
                held.setdefault(lang, []).append((codes, n))
                size += len(codes)
        if size > _FLUSH:
            yield from out()
            held, size = {}, 0
    yield from out()


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM,
             seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit vectors (languages x dim), learned from all rows with a language.

    N-grams are counted per language by Spark; only the profiles, one row per language and
    dimension, come to the driver: their size is bounded by the number of distinct languages.
    """
    small_batches(docs.sparkSession)
    counts = (docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
              .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
              .mapInPandas(_count_grams, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for at in range(0, len(part), 4096):
                    v = gram_vectors(part["gram"].to_numpy()[at:at + 4096], dim, seed)
                    total[lang] = total.get(lang, 0) + part["n"].to_numpy(np.float64)[at:at + 4096] @ v.astype(np.float64)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(dim), "x": v})

    rows = (counts.mapInPandas(bundle, "lang string, dim long, x double")
            .groupBy("lang", "dim").agg(F.sum("x").alias("x")).toPandas())
    langs = sorted(set(rows["lang"]))
    out = np.zeros((len(langs), dim))
    out[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), rows["dim"].to_numpy(int)] = rows["x"]
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _scores(texts: list[str | None], model: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, whether it has a letter, and its cosines with all profiles."""
    own = [grams(t) for t in texts]
    codes = np.unique(np.concatenate([c for c, _ in own]))
    counts = np.zeros((len(own), len(codes)), np.float32)
    for row, (c, n) in zip(counts, own):
        row[np.searchsorted(codes, c)] = n
    v = np.zeros((len(own), model.shape[1]))
    for at in range(0, len(codes), 4096):  # whole numbers far below 2**24: exact in single precision
        v += counts[:, at:at + 4096] @ gram_vectors(codes[at:at + 4096], model.shape[1], seed).astype(np.float32)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.array([len(c) > 0 for c, _ in own], bool), (v @ model.T) / np.maximum(norm, 1e-12)


def predict(text: Column, langs: list[str], model: np.ndarray, seed: int = SEED) -> Column:
    """Struct of ``lang_pred`` and ``score``: the nearest profile's language (ties: the first in
    order) and its cosine, at least 0; ``und`` and 0 for a text without letters, or if nothing
    was learned."""
    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        found: list[tuple[str, float]] = []
        for at in range(0, len(texts), 64):
            has, cos = _scores(list(texts[at:at + 64]), model, seed)
            for h, c in zip(has, cos):
                k = int(np.argmax(c)) if h and len(langs) else -1
                found.append((langs[k], float(min(1.0, max(0.0, c[k])))) if k >= 0 else ("und", 0.0))
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return run(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def learned_rows(docs: DataFrame, id_col: str = "doc_id", folds: int = 5) -> DataFrame:
    """Rows that may be learned from: with an id, and not held out."""
    return docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds))


def identify(docs: DataFrame, learn_from: DataFrame | None = None, folds: int = 5, dim: int = DIM) -> DataFrame:
    """``docs`` with held_out, lang_pred and score (columns of those names are replaced).

    Profiles come from the rows of ``learn_from`` (default ``docs``) outside the held-out fold;
    a prediction sees the text alone. Null texts and texts without letters are ``und`` with score
    0, as is every row if no row has a language; repeated rows get equal results; an empty table
    stays empty.
    """
    langs, model = profiles(learned_rows(docs if learn_from is None else learn_from, folds=folds), dim=dim)
    kept = docs.drop("held_out", "lang_pred", "score")
    rows = kept.select(as_row(kept).alias("row"), held_out(F.col("doc_id"), folds).alias("held_out"), predict(F.col("text"), langs, model).alias("p"))
    return rows.select(*from_row(kept), "held_out", "p.lang_pred", "p.score")
