"""Broadcasts whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a broadcast side at most.
MOST = 10_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """df, to be broadcast if it has `most` rows at most (counted no further than that), else to be merged: no row
    is left out either way."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
