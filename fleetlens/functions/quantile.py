"""Exact interpolated percentiles that never gather a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one buffer,
so an app with a third of all samples would have to fit in one task. Here:

1. count rows per (group, logarithmic bucket): partial aggregation reduces each
   input task to a few thousand rows;
2. a running count over the buckets finds the one or two buckets that hold the
   wanted ranks;
3. only the rows of those buckets are read again, counted per value, and ranked.

A bucket spans 0.1 % of its magnitude, which for the contract's 32-bit floats is
at most about 17,000 distinct values, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.keys import key_names, with_keys

BUCKET_WIDTH = math.log(1.001)
# Larger than |ln(x)| / BUCKET_WIDTH for any finite double, so signs never mix.
BUCKET_SHIFT = 1_000_000
# Target rows pulled to the driver to fix the second pass; beyond this the
# targets stay distributed.
MAX_LOCAL_TARGETS = 50_000


def log_bucket(value: Column) -> Column:
    """An integer that grows with ``value``: monotone, and 0.1 % wide."""
    size = F.floor(F.ln(F.abs(value)) / BUCKET_WIDTH).cast("int") + BUCKET_SHIFT
    return (F.when(F.isnan(value), 3 * BUCKET_SHIFT)
            .when(value == float("inf"), 2 * BUCKET_SHIFT + 1)
            .when(value == float("-inf"), -2 * BUCKET_SHIFT - 1)
            .when(value > 0, size).when(value < 0, -size).otherwise(0))


def exact_percentile(rows: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """One row per ``keys`` with the interpolated percentile ``name`` of ``value``.

    The first pass runs when this is called (its result is one or two rows per
    group); the returned frame holds the second pass only. Results are those of the
    built-in ``percentile``, bit for bit, also for infinities and NaN (the largest).
    """
    groups = key_names(keys)
    rows = (with_keys(rows.filter(F.col(value).isNotNull()), keys)
            .select(*groups, *keys, F.col(value).cast("double").alias("_v"))
            .withColumn("_b", log_bucket(F.col("_v"))))

    buckets = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    targets = target_buckets(buckets, groups, p)
    fixed = targets.take(MAX_LOCAL_TARGETS + 1)
    if len(fixed) <= MAX_LOCAL_TARGETS:
        # Size just checked: a local relation this small is joined map-side. Rows
        # outside all target buckets fall to a plain range test before the join.
        targets = F.broadcast(rows.sparkSession.createDataFrame(fixed, targets.schema))
        ends = [end for row in fixed for end in (row["_least"], row["_most"])]
        if ends and not any(map(math.isnan, ends)):
            rows = rows.filter(F.col("_v").between(min(ends), max(ends)))

    counted = (rows.join(targets.drop("_least", "_most"), [*groups, "_b"])
               .groupBy(*groups, *keys, "_v", "_pos", "_lo", "_hi")
               .agg(F.count("*").alias("_n"), F.min("_before").alias("_before")))
    return ranked_values(counted, groups, keys, name)


def target_buckets(buckets: DataFrame, groups: list[str], p: float) -> DataFrame:
    """The one or two buckets of each group that hold the wanted ranks, and how many rows come before them.

    ``buckets``: groups, _b, _n, _least, _most.
    """
    group = Window.partitionBy(*groups)
    buckets = (buckets
               .withColumn("_upto", F.sum("_n").over(group.orderBy("_b")))
               .withColumn("_pos", (F.sum("_n").over(group) - 1) * F.lit(float(p)))
               .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos")))

    def holds(rank: str) -> Column:
        return (F.col("_upto") - F.col("_n") <= F.col(rank)) & (F.col(rank) < F.col("_upto"))

    return (buckets.filter(holds("_lo") | holds("_hi"))
            .select(*groups, "_b", "_pos", "_lo", "_hi", "_least", "_most", (F.col("_upto") - F.col("_n")).alias("_before")))


def ranked_values(counted: DataFrame, groups: list[str], keys: list[str], name: str) -> DataFrame:
    """The percentile from the counted values of the target buckets: groups, keys, _v, _n, _before and the ranks."""
    group = Window.partitionBy(*groups)
    ranks, columns = ["_pos", "_lo", "_hi"], list(dict.fromkeys([*groups, *keys]))
    ranked = counted.withColumn(
        "_upto", F.min("_before").over(group) + F.sum("_n").over(group.orderBy("_v")))
    low = F.min(F.when(F.col("_upto") > F.col("_lo"), F.col("_v")))
    high = F.min(F.when(F.col("_upto") > F.col("_hi"), F.col("_v")))
    weight = F.col("_pos") - F.col("_lo")
    between = (F.col("_hi") - F.col("_pos")) * F.col("_low") + weight * F.col("_high")
    return (ranked.groupBy(*columns, *ranks).agg(low.alias("_low"), high.alias("_high"))
            .select(*keys, F.when((weight == 0) | (F.col("_low") == F.col("_high")), F.col("_low"))
                    .otherwise(between).alias(name)))
