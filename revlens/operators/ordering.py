"""ORDER BY with PostgreSQL NULL placement (ASC NULLS LAST, DESC NULLS FIRST)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pg_sort_keys(*specs: str | Column) -> list[Column]:
    """'col' -> ascending NULLS LAST, '-col' -> descending NULLS FIRST; Columns pass through."""
    keys = []
    for s in specs:
        if isinstance(s, Column):
            keys.append(s)
        elif s.startswith("-"):
            keys.append(F.col(s[1:]).desc_nulls_first())
        else:
            keys.append(F.col(s).asc_nulls_last())
    return keys


def pg_order(df: DataFrame, *specs: str | Column) -> DataFrame:
    """Global sort (range-partitioned, distributed) with PostgreSQL NULL placement."""
    return df.orderBy(*pg_sort_keys(*specs))
