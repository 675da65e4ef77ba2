"""Joins of rows that may share a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, salt_by: list[str], how: str = "inner",
                salts: int = 16) -> DataFrame:
    """Many-to-one join of ``rows`` with ``keyed`` (a row per key at most): the
    rows of a key are dealt to ``salts`` tasks by a hash of ``salt_by``, and
    ``keyed`` is repeated for each. AQE's own splitting does not reach a side
    that was aggregated by the key just before the join."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    repeated = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")
