"""Joining points to the intervals that hold them, without pairing all of a key.

An interval of length up to 2^l microseconds covers one or two bins of that width, so it becomes one or two
rows of level l; a point has one bin for each level that occurs (at most 62, a handful in practice).
Both meet on (key, level, bin), an equi-join whose groups are short however many points or
intervals a key has, and the exact bounds are checked on what has met: of that, at least about a
third is kept where intervals of a level follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.sizing import small_side


def _level(length: Column) -> Column:
    """The smallest l with 2^l >= length."""
    return F.length(F.bin(F.greatest(length - 1, F.lit(1).cast("long")))).cast("int")


def binned(intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """The intervals [start, end) in microseconds, once for each bin of their level; empty ones are dropped."""
    rows = intervals.withColumn("_lo", start).withColumn("_hi", end).filter("_lo < _hi")
    rows = rows.withColumn("_level", _level(F.col("_hi") - F.col("_lo")))
    first = F.call_function("shiftright", F.col("_lo"), F.col("_level"))
    last = F.call_function("shiftright", F.col("_hi") - 1, F.col("_level"))
    return rows.withColumn("_bin", F.explode(F.sequence(first, last)))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: Column, start: Column, end: Column) -> DataFrame:
    """Each point with every interval of its key that holds it: start <= at < end, all in microseconds.

    The columns of both; ``on`` is in the result once. Few intervals are broadcast behind a count.
    """
    rows = binned(intervals, start, end)
    levels = [r[0] for r in rows.select("_level").distinct().collect()]  # at most 62
    probe = (points.withColumn("_at", at).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>")))
             .withColumn("_bin", F.call_function("shiftright", F.col("_at"), F.col("_level"))))
    met = probe.join(small_side(rows), [*on, "_level", "_bin"])
    return met.filter("_lo <= _at AND _at < _hi").drop("_lo", "_hi", "_at", "_level", "_bin")
