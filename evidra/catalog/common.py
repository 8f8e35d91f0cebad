"""Small helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round the named doubles so that both engines print the same digits."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
