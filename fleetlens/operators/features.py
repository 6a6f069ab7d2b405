"""One-pass features: everything the rules and the root-cause queries read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fleetlens.config import Thresholds
from fleetlens.functions.keys import key_names, with_keys
from fleetlens.functions.quantile import exact_percentile
from fleetlens.functions.stats import latest_if, mean_if, slope_and_corr_if, slope_if
from fleetlens.operators.windows import Instant, label_slots, slot_keys, spread_slots, tag_instants
from fleetlens.session import checkpoint

P95 = 0.95


@dataclass(frozen=True)
class Frames:
    """The two feature frames everything else is derived from: one row per
    (asof, VM) and one per (asof, app), whatever the number of samples."""

    vm: DataFrame
    app: DataFrame

    def kept(self) -> "Frames":
        """The frames checkpointed, for several queries over the same instants."""
        return Frames(checkpoint(self.vm), checkpoint(self.app))


def frames(metrics: DataFrame, cfg: Thresholds, points: list[Instant], fleet: DataFrame | None = None) -> Frames:
    return Frames(vm_features(metrics, cfg, points, fleet), app_latency(metrics, cfg, points))


def vm_apps(metrics: DataFrame, points: list[Instant]) -> DataFrame:
    """(asof, vm key) -> app, taken from the recent and the heap window.

    Kept out of the feature aggregate: a string buffer there would turn the hash
    aggregation of the whole fact into a sort. This pass reads three columns.
    """
    vm, slot = key_names(["vm_id"]), slot_keys(points)
    rows = tag_instants(metrics.select(*_present(metrics, "ts", "ts_day", "vm_id", "app")), points)
    seen = (with_keys(rows.filter(F.col("in_recent") | F.col("in_heap")), ["vm_id"])
            .groupBy(*slot, *vm, "app").agg(F.max("in_recent").alias("recent")))
    apps = seen.groupBy(*slot, *vm).agg(
        F.max(F.when(F.col("recent"), F.col("app"))).alias("app_recent"), F.max("app").alias("app_heap"))
    return label_slots(apps, points).drop("t_end")


def vm_features(metrics: DataFrame, cfg: Thresholds, points: list[Instant],
                fleet: DataFrame | None = None) -> DataFrame:
    """One row per (asof, vm_id) with the statistics of all three windows.

    A single conditional aggregation, one shuffle. ``fleet`` (vm_id, app) spares
    the app lookup where the caller keeps such a dimension.
    """
    ts = F.col("ts")
    rows = tag_instants(metrics, points)
    recent, heap, base = F.col("in_recent"), F.col("in_heap"), F.col("in_base")
    # Minutes relative to the instant: slopes do not depend on the origin, and
    # small numbers keep the regression sums accurate.
    minutes = (F.unix_micros(ts) - F.unix_micros("t_end")) / F.lit(float(cfg.unit_us))
    heap_mb, io = F.col("heap_mb"), F.col("disk_io_await_ms")
    slope, corr = slope_and_corr_if(heap, heap_mb, minutes)

    vm = key_names(["vm_id"])
    stats = with_keys(rows, ["vm_id"]).groupBy(*slot_keys(points), *vm).agg(
        F.count_if(heap).alias("n_heap"), slope.alias("heap_slope"), corr.alias("heap_corr"),
        latest_if(heap, heap_mb, ts).alias("heap_now"),
        F.count_if(recent).alias("n_recent"),
        mean_if(recent, io).alias("io_recent"),
        latest_if(recent, F.col("disk_iops"), ts).alias("iops_now"),
        mean_if(recent, F.col("net_retrans_pct")).alias("retrans_recent"),
        mean_if(recent, F.col("error_rate_pct")).alias("err_recent"),
        mean_if(recent, F.col("gc_pause_ms")).alias("gc_recent"),
        mean_if(recent, F.col("app_latency_ms")).alias("latency_recent"),
        slope_if(recent, heap_mb, minutes).alias("heap_slope_recent"),
        latest_if(recent, heap_mb, ts).alias("heap_now_recent"),
        F.count_if(base).alias("n_base"),
        mean_if(base, io).alias("io_base"),
        F.stddev_samp(F.when(base, io.cast("double"))).alias("io_base_std"),
        mean_if(base, F.col("error_rate_pct")).alias("err_base"),
    )
    stats = spread_slots(stats, points, vm)
    if fleet is None:
        apps = vm_apps(metrics, points)
        stats = stats.join(apps.drop("asof") if len(points) == 1 else apps,
                           vm if len(points) == 1 else ["asof", *vm], "left")
    else:
        known = (with_keys(fleet, ["vm_id"]).groupBy(*vm).agg(F.max("app").alias("app_recent"))
                 .withColumn("app_heap", F.col("app_recent")))
        stats = stats.join(known, vm, "left")
    return stats.select(
        "asof", "t_end", F.when(~F.col("_z0"), F.col("_k0")).alias("vm_id"),
        F.coalesce("app_recent", "app_heap").alias("app"),
        *[name for name in stats.columns if name not in ("asof", "t_end", *vm)])


def app_latency(metrics: DataFrame, cfg: Thresholds, points: list[Instant]) -> DataFrame:
    """One row per (asof, app): p95 latency of the recent and the baseline window."""
    rows = tag_instants(
        metrics.select(*_present(metrics, "ts", "ts_day", "app", "app_latency_ms")), points, heap=False)
    # recent and baseline never overlap, so one flag tells them apart
    rows = rows.select("slot", "app", F.when(F.col("in_recent"), 1).otherwise(0).alias("recent"), "app_latency_ms")
    p95 = exact_percentile(rows, [*slot_keys(points), "app", "recent"], "app_latency_ms", P95, "p95")
    both = p95.groupBy(*slot_keys(points), "app").agg(
        F.max(F.when(F.col("recent") == 1, F.col("p95"))).alias("p95_recent"),
        F.max(F.when(F.col("recent") == 0, F.col("p95"))).alias("p95_base"))
    return spread_slots(both, points, ["app"])


def _present(df: DataFrame, *names: str) -> list[str]:
    return [name for name in names if name in df.columns]
