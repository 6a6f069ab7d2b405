"""Approximate latency percentiles and distinct VMs from stored, mergeable sketches.

One row per (day, app) holds a KLL sketch of the latency and a HyperLogLog sketch of the VM
ids. A question about any days merges these rows, and the samples are not read again. The exact
operators stay the default; this is for spans where an exact answer is not worth a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: KLL parameter: the normalized rank error is about 2.3 / K^0.9 (0.8 % here, with 99 % confidence).
K = 512
#: HyperLogLog: 2^LG buckets, a relative error of about 1.04 / 2^(LG / 2) (0.8 % here).
LG = 14


def daily(metrics: DataFrame) -> DataFrame:
    """(day, app, n, latency, vms): the sketches of each day and app, to be stored."""
    return (metrics.groupBy(F.to_date("ts").alias("day"), "app").agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("app_latency_ms").cast("double"), K).alias("latency"),
        F.hll_sketch_agg("vm_id", LG).alias("vms")))


def merged(sketches: DataFrame) -> DataFrame:
    """(app, n, latency, vms): the rows of any days put together."""
    return sketches.groupBy("app").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("latency").alias("latency"),
                                       F.hll_union_agg("vms").alias("vms"))


def answers(sketches: DataFrame, p: float = 0.95) -> DataFrame:
    """(app, n, quantile, n_vms): approximate, from the merged sketches."""
    return merged(sketches).select("app", "n", F.kll_sketch_get_quantile_double("latency", F.lit(p)).alias("quantile"),
                                   F.hll_sketch_estimate("vms").alias("n_vms"))


def rank_errors(metrics: DataFrame, found: DataFrame, p: float = 0.95) -> DataFrame:
    """(app, rank_error, vm_error): how far the answers are from the samples, as shares of all."""
    v = F.col("app_latency_ms").cast("double")
    exact = metrics.join(F.broadcast(found.select("app", "quantile", "n_vms")), "app").groupBy("app").agg(  # a row for each app
        F.count(v).alias("seen"), F.count_if(v < F.col("quantile")).alias("below"), F.count_if(v <= F.col("quantile")).alias("upto"),
        F.count_distinct("vm_id").alias("vms"), F.max("n_vms").alias("n_vms"))
    # Equal values span a range of ranks; p inside of it is no error.
    off = F.greatest(F.col("below") / F.col("seen") - p, p - F.col("upto") / F.col("seen"), F.lit(0.0))
    return exact.select("app", off.alias("rank_error"), (F.abs(F.col("n_vms") - F.col("vms")) / F.col("vms")).alias("vm_error"))
