"""Exploding computed arrays without re-evaluating them.

For a plain ``explode``, Catalyst infers ``size(arr) > 0`` and pushes that
filter below the projection, which re-inlines (and so recomputes) the whole
array expression — for regex-built arrays that doubles the regex work or
worse. ``explode_outer`` gets no inferred filter; dropping the NULL row it
emits for an empty array gives the same rows as ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, arr: Column, alias: str, keep: list | None = None,
                 pos_alias: str | None = None) -> DataFrame:
    """Rows of ``keep`` columns × elements of ``arr`` (elements must be non-NULL)."""
    keep = list(keep) if keep is not None else []
    if pos_alias:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos_alias, alias))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.where(F.col(alias).isNotNull())
