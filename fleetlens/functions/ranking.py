"""Positions within a group, computed without putting the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.keys import key_names, with_keys
from fleetlens.session import checkpoint


def position_by_slice(df: DataFrame, keys: list[str], order: list[str], slice_: Column,
                      name: str) -> DataFrame:
    """0-based position of each row in ``order`` within ``keys``.

    ``slice_`` must grow with ``order`` (a time bucket, say). Rows are numbered
    per slice, and the number of rows in earlier slices is added; a hot key is
    thereby spread over its slices, and only the per-slice counts meet.
    """
    groups = key_names(keys)
    df = with_keys(df, keys).withColumn("_slice", slice_)
    counts = (df.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_slice")) - F.col("_n"))
              .drop("_n"))
    at = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(*order)) - 1
    return (df.withColumn("_at", at).join(counts, [*groups, "_slice"])
            .withColumn(name, F.col("_before") + F.col("_at"))
            .drop("_slice", "_at", "_before", *groups))


def position_by_sort(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """0-based position of each row in ``order`` within ``keys``.

    For orders with no natural slice (names): a range-partitioned sort numbers
    the rows of each partition, and the per-partition counts of a key give the
    offsets. The sorted rows are checkpointed because both steps must see the
    same partition boundaries.
    """
    groups = key_names(keys)
    ordered = checkpoint(
        with_keys(df, keys).orderBy(*groups, *order)
        .withColumn("_id", F.monotonically_increasing_id()))
    # The partition number sits above the lower 33 bits.
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33))
    runs = (ordered.groupBy(*groups, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
            .withColumn("_before", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_n"))
            .drop("_n"))
    return (ordered.join(runs, [*groups, "_part"])
            .withColumn(name, F.col("_id") - F.col("_first") + F.col("_before"))
            .drop("_id", "_part", "_first", "_before", *groups))
