"""Documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import langid, linededup, mixing, packing, simhash
from lexspark.llm.common import run_stages, table
from lexspark.llm.queries import BYTE_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (null text, no letters) go."""
    return langid.identify(docs).filter("lang_pred != 'und'").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents that consist of such lines."""
    return linededup.drop_duplicate_lines(docs, similarity=0.8)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1, repeating."""
    return mixing.mixed(docs, mixing.cycled([5, 2, 1]), share=1.5, most=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2,048 tokens. Workers that have
    run the other stages keep fewer words than packing alone does: what they hold stays to the end."""
    return packing.pack(docs, BYTE_BPE, length=2048, cached=1 << 17)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisers and fingerprints are beyond SQL; tests hold run() against the same operators called in a row.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_stages(spark, STAGES, table(spark, sf_dir, "documents"), sf_dir)
