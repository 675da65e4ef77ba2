"""One query per operator: production parameters over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, fptree, langid, licences, linededup, mixing, mtree, packing, passages, permutation, pitmanyor, simhash, tokencounts
from .common import table

#: Vocabulary files, the same path on all executors.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.duplicate_lines(table(spark, sf_dir, "documents"), similarity=0.8)


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), mixing.cycled([5, 2, 1]), share=1.5, most=2.0)
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, length=2048)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), PIECE_BPE, limit=4096)


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


ORACLES["op8_license_scan"] = licences.oracle_sql()


@query
def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def op9_ann_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"), similarity=0.8, min_words=15)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.best_phrases(table(spark, sf_dir, "documents"), top=2000, least=10, cover=50)


ORACLES["op12_collocations"] = collocations.oracle_sql()


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op11_lexical_search"] = fptree.oracle_sql()


@query
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"), folds=10)
