"""Broadcast only what has been counted.

For an aggregate of a large table Spark can only guess the size, and guesses
high: it would shuffle the large side of a join by a possibly hot key, and learn
too late that the other side was tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_ROWS = 50_000


def small_side(df: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """``df`` as a broadcast local table if it has at most ``limit`` rows.

    Fetches up to one row more than that. A larger frame is returned as it is and
    joined by shuffle, where the adaptive planner splits skewed partitions.
    """
    rows = df.take(limit + 1)
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
