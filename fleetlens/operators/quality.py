"""Data-quality and evaluation operators on telemetry tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.functions.ranking import position_by_slice, position_by_sort
from fleetlens.functions.sizing import small_side
from fleetlens.operators.intervals import interval_join
from fleetlens.schema import METRICS

col = F.col

# Absolute noise floors of the near-zero metrics.
NOISE_FLOOR = {"net_retrans_pct": 0.05, "error_rate_pct": 0.03, "gc_pause_ms": 1.0}
BAND_SIGMAS = 6.0

# Samples of one VM that one task may number.
SLICE_ROWS = 2_000_000


def clip_metrics(metrics: DataFrame) -> DataFrame:
    """Negative metric values become 0; nulls stay null."""
    zero = F.lit(0.0).cast("float")
    return metrics.withColumns({
        name: F.when(col(name).isNotNull(), F.greatest(col(name), zero)) for name in METRICS})


def downsample_fleet(fleet: DataFrame, target: int) -> DataFrame:
    """About ``target`` VMs, each app keeping its share (at least one VM).

    The first VMs of an app by id are kept. With ``target`` at or above the
    fleet size nothing is removed.
    """
    sizes = small_side(fleet.groupBy("app").agg(F.count("*").alias("n_app")))
    total = sizes.agg(F.sum("n_app")).first()[0] or 0
    if target >= total:
        return fleet
    quota = F.greatest(F.lit(1), F.bround(col("n_app") * F.lit(target / total), 0).cast("long"))
    ranked = position_by_sort(fleet, ["app"], ["vm_id"], "_position")
    return (ranked.join(sizes.select("app", quota.alias("_quota")), "app")
            .filter(col("_position") < col("_quota")).select(*fleet.columns))


def keep_vms(facts: DataFrame, fleet: DataFrame) -> DataFrame:
    """Fact rows of the VMs in ``fleet``."""
    wanted = small_side(fleet.select("vm_id").distinct())
    return facts.join(wanted, "vm_id", "left_semi").select(*facts.columns)


def select_vms(fleet: DataFrame, app: str | None = None, vms: Sequence[str] = (),
               site: str | None = None, count: int = 1) -> DataFrame:
    """Target VMs: an explicit list, or the first ``count`` of an app (and site)."""
    if vms:
        return fleet.filter(col("vm_id").isin(list(vms)))
    chosen = fleet.filter(col("app") == app)
    if site:
        chosen = chosen.filter(col("site") == site)
    return chosen.orderBy("vm_id").limit(count)


def first_vms(fleet: DataFrame, count: int) -> DataFrame:
    """The first ``count`` VMs of every (app, site): a top-k, reduced before its shuffle."""
    place = F.row_number().over(Window.partitionBy("app", "site").orderBy("vm_id"))
    return fleet.withColumn("place", place).filter(col("place") <= count)


def label_incidents(metrics: DataFrame, incidents: DataFrame, unit_s: float = 60.0) -> DataFrame:
    """Samples inside an incident of their VM: [start_ts, end_ts), with the rule
    minutes elapsed since its start.

    ``incidents``: incident, vm_id, start_ts, end_ts. Joined by time bins, so a VM with many
    samples and many incidents is no product of the two.
    """
    at, start = F.unix_micros("ts"), F.unix_micros("start_ts")
    joined = interval_join(metrics, incidents, ["vm_id"], at, start, F.unix_micros("end_ts"))
    elapsed = (at - start) / F.lit(unit_s * 1e6)
    return joined.select(*metrics.columns, "incident", elapsed.alias("elapsed_min"))


def first_crossings(metrics: DataFrame, cap_mb: float) -> DataFrame:
    """First sample per VM at which the heap reaches the cap, as an app event."""
    # Text stays in the keys of the first step, so it is a hash aggregation; the
    # second works on about one row per VM.
    first = (metrics.filter(col("heap_mb") >= cap_mb)
             .groupBy("vm_id", "app", "site").agg(F.min("ts").alias("ts"))
             .groupBy("vm_id").agg(F.min("ts").alias("first_ts"), F.min_by("app", "ts").alias("app"),
                                   F.min_by("site", "ts").alias("site")))
    return first.withColumnRenamed("first_ts", "ts").select(
        "ts", "vm_id", "app", "site", F.lit("ERROR").alias("level"), F.lit("oom_kill").alias("event_type"),
        F.lit(f"java.lang.OutOfMemoryError: Java heap space (cap {int(cap_mb)}MB)").alias("message"))


def time_slice(metrics: DataFrame, limit: int = SLICE_ROWS) -> str:
    """The longest time unit in which no VM has more than ``limit`` samples."""
    for unit in ("day", "hour", "minute"):
        sizes = metrics.groupBy("vm_id", F.date_trunc(unit, "ts")).agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= limit:
            return unit
    return "second"


def thin(metrics: DataFrame, every: int, slice_: str | None = None) -> DataFrame:
    """Every ``every``-th sample of each VM in time order, starting with its first.

    Positions are counted per VM and time slice, so a VM with a large part of
    all samples is numbered by many tasks; the slice follows the busiest VM.
    """
    unit = slice_ or time_slice(metrics)
    # every column decides among equal times, so a repeated task numbers alike
    order = ["ts", *sorted(c for c in metrics.columns if c not in ("ts", "vm_id"))]
    numbered = position_by_slice(metrics, ["vm_id"], order, F.date_trunc(unit, "ts"), "_position")
    return numbered.filter(col("_position") % every == 0).drop("_position")


def app_means(metrics: DataFrame) -> DataFrame:
    """(app, mean_<metric>...): the baseline table of the band audit."""
    return metrics.groupBy("app").agg(*[F.avg(col(m).cast("double")).alias(f"mean_{m}") for m in METRICS])


def band_audit(metrics: DataFrame, baseline: DataFrame, noise: float) -> DataFrame:
    """(app, metric, n_samples, n_outside): samples outside mean +- 6 sigma, where
    sigma = max(noise * |mean|, floor) and the lower end is clipped at 0.

    Counted wide in one aggregation and unpivoted afterwards, so the fact is not
    repeated nine times.
    """
    def outside(m: str) -> Column:
        mean, value = col(f"mean_{m}"), col(m).cast("double")
        sigma = F.greatest(F.abs(mean) * noise, F.lit(NOISE_FLOOR.get(m, 0.0)))
        low = F.greatest(mean - sigma * BAND_SIGMAS, F.lit(0.0))
        return (value < low) | (value > mean + sigma * BAND_SIGMAS)

    counted = metrics.join(small_side(baseline), "app").groupBy("app").agg(
        *[F.struct(F.count(m).alias("n_samples"), F.count_if(outside(m)).alias("n_outside")).alias(m)
          for m in METRICS])
    long = counted.unpivot("app", METRICS, "metric", "x")
    return long.select("app", "metric", "x.n_samples", "x.n_outside")


def score(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Per rule: true positives, false positives, false negatives.

    ``labels``: rule, vm_id — what should have been detected.
    """
    found = alerts.select("rule", "vm_id").distinct().withColumn("found", F.lit(True))
    truth = labels.select("rule", "vm_id").distinct().withColumn("true", F.lit(True))
    both = found.join(truth, ["rule", "vm_id"], "full")
    hit, due = col("found").isNotNull(), col("true").isNotNull()
    return both.groupBy("rule").agg(
        F.count_if(hit & due).alias("tp"), F.count_if(hit & ~due).alias("fp"), F.count_if(~hit & due).alias("fn"))


def lead_times(timeline: DataFrame, crossings: DataFrame, unit_s: float = 60.0) -> DataFrame:
    """(vm_id, first_alert, crossing, lead_min): rule minutes between the first
    heap-leak alert of a replay and the VM's first crossing."""
    first = timeline.groupBy("vm_id").agg(F.min("t_end").alias("first_alert"))
    lead = (F.unix_micros("crossing") - F.unix_micros("first_alert")) / F.lit(unit_s * 1e6)
    return (first.join(crossings.select("vm_id", col("ts").alias("crossing")), "vm_id")
            .withColumn("lead_min", lead))
