"""Fleet-health views: KPI header, grid, heap series, default VM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.config import Thresholds
from fleetlens.functions.ranking import position_by_sort
from fleetlens.functions.stats import severity_rank
from fleetlens.operators.windows import at, instants

col = F.col


def vm_list(metrics: DataFrame) -> DataFrame:
    """Distinct (vm_id, app) with their sample count; stored partials are such a list already."""
    if "n_samples" in metrics.columns:
        return metrics.select("vm_id", "app", "n_samples")
    return metrics.groupBy("vm_id", "app").agg(F.count("*").alias("n_samples"))


def kpis(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: VMs, apps, samples, P1 and P2 alerts.

    Samples are first reduced to one row per VM; the distinct counts then run
    over the fleet, not over the fact.
    """
    fleet = vm_list(metrics).withColumn("severity", F.lit(None).cast("string"))
    active = alerts.select(
        F.lit(None).cast("string").alias("vm_id"), F.lit(None).cast("string").alias("app"),
        F.lit(0).cast("long").alias("n_samples"), "severity")
    return fleet.unionByName(active).agg(
        F.count_distinct("vm_id").alias("n_vms"), F.count_distinct("app").alias("n_apps"),
        F.sum("n_samples").alias("n_samples"),
        F.count_if(col("severity") == "P1").alias("n_p1"), F.count_if(col("severity") == "P2").alias("n_p2"))


def vm_rank(alerts: DataFrame) -> DataFrame:
    """(vm_id, rank): 2 for a P1, 1 for a P2. App-level alerts colour no VM."""
    rank = F.when(col("severity") == "P1", 2).when(col("severity") == "P2", 1).otherwise(0)
    return alerts.filter(col("vm_id") != "").groupBy("vm_id").agg(F.max(rank).alias("rank"))


def vm_status(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """(vm_id, app, rank, status): one row per VM and app."""
    rank = F.coalesce("rank", F.lit(0))
    return (vm_list(metrics).select("vm_id", "app").join(vm_rank(alerts), "vm_id", "left")
            .select("vm_id", "app", rank.alias("rank"),
                    F.when(rank == 2, "P1").when(rank == 1, "P2").otherwise("healthy").alias("status")))


def grid(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """The status rows with each VM's ordinal inside its app."""
    return position_by_sort(vm_status(metrics, alerts), ["app"], ["vm_id"], "i")


def phase(t_end: Column) -> Column:
    return F.when(col("ts") <= t_end, "known").otherwise("after-now")


def heap_series(metrics: DataFrame, cfg: Thresholds, vm_id: str, asof: float = 0.0) -> DataFrame:
    """The heap of one VM over all time, with the ceiling and the phase."""
    point = instants(metrics, cfg, asof)[0]
    return (metrics.filter(col("vm_id") == vm_id)
            .select("ts", "heap_mb", phase(at(point.end)).alias("phase"),
                    F.lit(float(cfg.heap_cap_mb)).alias("heap_cap_mb"))
            .orderBy("ts"))


def default_vm(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """The VM to show first: the first heap-leak alert, else the first by name."""
    leaks = alerts.filter(col("rule") == "heap_leak").select(
        F.lit(0).alias("choice"), severity_rank(col("severity")).alias("rank"), "vm_id")
    names = metrics.filter(col("vm_id").isNotNull()).select("vm_id").distinct().select(
        F.lit(1).alias("choice"), F.lit(0).alias("rank"), "vm_id")
    return leaks.unionByName(names).orderBy("choice", "rank", "vm_id").limit(1).select("vm_id")
