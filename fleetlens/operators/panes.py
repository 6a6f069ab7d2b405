"""Pane moments: samples are added up once, windows are put together from panes.

Time is cut into panes of one step, (i - 1, i] * step after an origin. A pane of a VM keeps
mergeable moments: counts, sums, sums of squares and products, extremes, and the latest
value with its time. A window that starts and ends on pane ends is the merger of its
panes, whatever the number of windows that share them. Live rules and the sweep over many
instants both stand on this.

A pane's samples exactly at its end are kept apart from those inside it (`half` numbers them 2i and
2i - 1), so a window may be open or closed at either end.

Regression sums are taken relative to the end of their pane and moved to a common reference when panes
merge, so numbers stay as small as the span that is looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.config import Thresholds
from fleetlens.functions.keys import key_names, with_keys
from fleetlens.functions.quantile import log_bucket, ranked_values, target_buckets
from fleetlens.functions.sizing import small_side
from fleetlens.operators.windows import Instant, _prefilter, at

col = F.col


@dataclass(frozen=True)
class Grid:
    """Panes of ``step`` microseconds that end at ``origin`` + i * step."""

    origin: int
    step: int
    recent: int    # panes of the recent window
    heap: int      # panes of the heap window

    @property
    def longest(self) -> int:
        return max(self.recent, self.heap)

    def half(self, us: Column) -> Column:
        """2i for an instant at the end of pane i, 2i - 1 for one inside it."""
        away = us - F.lit(self.origin)
        rest = F.pmod(away, F.lit(self.step))
        whole = F.floor((away - rest) / F.lit(self.step)).cast("long") * 2  # exact: a multiple, below 2 ** 53
        return F.when(rest == 0, whole).otherwise(whole + 1)

    def number(self, us: int) -> int:
        """The same for a plain number."""
        whole, rest = divmod(us - self.origin, self.step)
        return 2 * whole + (1 if rest else 0)


def common_grid(points: list[Instant], cfg: Thresholds) -> Grid:
    """The coarsest grid on whose pane ends all instants and both windows end."""
    origin = max(p.end for p in points)
    recent, heap = cfg.recent_min * cfg.unit_us, cfg.heap_min * cfg.unit_us
    step = math.gcd(recent, heap, *(origin - p.end for p in points))
    return Grid(origin, step, recent // step, heap // step)


def live_grid(cfg: Thresholds, slide_s: float) -> Grid:
    """The grid of a stream: panes of one slide, counted from the epoch."""
    step = int(slide_s) * 1_000_000
    recent, heap = cfg.recent_min * cfg.unit_us, cfg.heap_min * cfg.unit_us
    if recent % step or heap % step:
        raise ValueError("windows must be whole numbers of slides")
    return Grid(0, step, recent // step, heap // step)


# --- moments ------------------------------------------------------------------

def moments(end_us: Column, cfg: Thresholds) -> list[Column]:
    """The aggregates of a pane that ends at ``end_us``. All buffers are primitives."""
    us = F.unix_micros("ts")
    io, retrans, err = (col(c).cast("double") for c in ("disk_io_await_ms", "net_retrans_pct", "error_rate_pct"))
    iops, y = col("disk_iops").cast("double"), col("heap_mb").cast("double")
    x = F.when(y.isNotNull(), (us - end_us) / F.lit(float(cfg.unit_us)))
    seen_iops, seen_y = F.when(iops.isNotNull(), us), F.when(y.isNotNull(), us)
    return [
        F.count("*").alias("n"), F.count(io).alias("n_io"), F.sum(io).alias("s_io"), F.sum(io * io).alias("q_io"),
        F.count(retrans).alias("n_ret"), F.sum(retrans).alias("s_ret"), F.count(err).alias("n_err"), F.sum(err).alias("s_err"),
        F.max(seen_iops).alias("iops_us"), F.max_by(iops, seen_iops).alias("iops_last"),
        F.count(y).alias("n_y"), F.sum(x).alias("s_x"), F.sum(y).alias("s_y"), F.sum(x * y).alias("s_xy"),
        F.sum(x * x).alias("q_x"), F.sum(y * y).alias("q_y"), F.min(seen_y).alias("first_us"), F.max(seen_y).alias("heap_us"),
        F.min(y).alias("low_y"), F.max(y).alias("high_y"), F.max_by(y, seen_y).alias("heap_last")]


MOMENTS = ["n", "n_io", "s_io", "q_io", "n_ret", "s_ret", "n_err", "s_err", "iops_us", "iops_last", "n_y", "s_x", "s_y",
           "s_xy", "q_x", "q_y", "first_us", "heap_us", "low_y", "high_y", "heap_last"]


def vm_panes(metrics: DataFrame, cfg: Thresholds, grid: Grid, points: list[Instant]) -> DataFrame:
    """(vm_id, app, pre, key, moments) of all panes that a window of the instants needs.

    ``pre`` tells samples of the fixed baseline window, before it is cut short by an early instant.
    """
    base = points[0].start, points[0].start + cfg.baseline_min * cfg.unit_us
    rows = _prefilter(metrics, points, heap=True)
    rows = rows.withColumn("key", grid.half(F.unix_micros("ts"))).withColumn(
        "pre", (col("ts") >= at(base[0])) & (col("ts") < at(base[1])))
    end = F.lit(grid.origin) + F.shiftright(col("key") + 1, 1) * F.lit(grid.step)
    return rows.groupBy("vm_id", "app", "pre", "key").agg(*moments(end, cfg))


def rolled(panes: DataFrame, marks: DataFrame, cfg: Thresholds, grid: Grid, reference: Column | int = 0) -> DataFrame:
    """The features of the windows that end at each mark.

    ``panes``: vm_id, app, pre, key and moments. ``marks``: vm_id, key (an even number: 2 * index of a pane end) and any
    further columns, which are kept. ``reference``: the index of a pane end near the marks, to which regression sums
    are moved. A VM's panes and marks meet in one window task; there are as many as panes, not samples.
    """
    extra = [c for c in marks.columns if c not in ("vm_id", "key")]
    unit = F.lit(grid.step / cfg.unit_us)
    reference = F.lit(reference) if isinstance(reference, int) else reference
    d = (F.shiftright(col("key") + 1, 1) - reference) * unit
    moved = panes.withColumns({
        "s_x": col("s_x") + col("n_y") * d, "s_xy": col("s_xy") + d * col("s_y"),
        "q_x": col("q_x") + 2 * d * col("s_x") + col("n_y") * d * d}).withColumn("mark", F.lit(False))
    rows = moved.unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy("vm_id").orderBy("key")
    recent, heap = order.rangeBetween(1 - 2 * grid.recent, 0), order.rangeBetween(1 - 2 * grid.heap, 0)
    either = order.rangeBetween(1 - 2 * grid.longest, 0)
    base = order.rangeBetween(Window.unboundedPreceding, -2 * grid.recent - 1)

    def total(name: str, over, only: Column | None = None) -> Column:
        value = col(name) if only is None else F.when(only, col(name))
        return F.coalesce(F.sum(value).over(over), F.lit(0))

    pre = col("pre")
    summed = rows.select(
        "vm_id", "key", "mark", *extra,
        F.max("app").over(recent).alias("app_recent"), F.max("app").over(either).alias("app_heap"),
        total("n", recent).alias("n_recent"),
        F.try_divide(total("s_io", recent), total("n_io", recent)).alias("io_recent"),
        F.try_divide(total("s_ret", recent), total("n_ret", recent)).alias("retrans_recent"),
        F.try_divide(total("s_err", recent), total("n_err", recent)).alias("err_recent"),
        F.max_by("iops_last", "iops_us").over(recent).alias("iops_now"),
        total("n", heap).alias("n_heap"), *[total(c, heap).alias(f"h_{c}") for c in ("n_y", "s_x", "s_y", "s_xy", "q_x", "q_y")],
        F.min("first_us").over(heap).alias("first_us"), F.max("heap_us").over(heap).alias("heap_us"),
        F.min("low_y").over(heap).alias("low_y"), F.max("high_y").over(heap).alias("high_y"),
        F.max_by("heap_last", "heap_us").over(heap).alias("heap_now"),
        total("n", base, pre).alias("n_base"), total("n_io", base, pre).alias("b_n_io"), total("s_io", base, pre).alias("b_s_io"),
        total("q_io", base, pre).alias("b_q_io"), total("n_err", base, pre).alias("b_n_err"), total("s_err", base, pre).alias("b_s_err"),
    ).filter("mark")
    n = col("h_n_y")
    together = F.try_divide(n * col("h_s_xy") - col("h_s_x") * col("h_s_y"), n * n)
    var_x = F.try_divide(n * col("h_q_x") - col("h_s_x") * col("h_s_x"), n * n)
    var_y = F.try_divide(n * col("h_q_y") - col("h_s_y") * col("h_s_y"), n * n)
    moving, varied = col("first_us") < col("heap_us"), col("low_y") < col("high_y")
    zero = F.lit(0.0)
    spread = F.greatest(var_x, zero), F.greatest(var_y, zero)
    m = col("b_n_io")
    around = F.greatest(F.try_divide(col("b_q_io") - F.try_divide(col("b_s_io") * col("b_s_io"), m), m - 1), zero)
    found = summed.select(
        *extra, "vm_id", "key", F.coalesce("app_recent", "app_heap").alias("app"), "app_recent", "app_heap",
        "n_recent", "io_recent", "retrans_recent", "err_recent", "iops_now", "n_heap", "heap_now",
        F.when(moving, F.when(varied, F.try_divide(together, var_x)).otherwise(zero)).alias("heap_slope"),
        F.when(moving & varied, F.try_divide(together, F.sqrt(spread[0]) * F.sqrt(spread[1]))).alias("heap_corr"),
        "n_base", F.try_divide("b_s_io", "b_n_io").alias("io_base"), F.sqrt(F.when(m > 1, around)).alias("io_base_std"),
        F.try_divide("b_s_err", "b_n_err").alias("err_base"))
    return found.filter("n_recent > 0 OR n_heap > 0 OR n_base > 0")


def sweep_features(metrics: DataFrame, cfg: Thresholds, points: list[Instant]) -> DataFrame:
    """One row per (asof, VM), as ``vm_features`` gives for the rules, from one pass over the samples.

    The scan and the shuffle do not depend on the number of instants; they are marks among a VM's panes.
    """
    grid = common_grid(points, cfg)
    panes = vm_panes(metrics, cfg, grid, points)
    instants = F.array(*[F.struct(F.lit(p.asof).alias("asof"), F.lit(grid.number(p.end)).cast("long").alias("key")) for p in points])
    marks = panes.select("vm_id").distinct().select("vm_id", F.inline(instants))
    found = rolled(panes, marks, cfg, grid)
    end = F.timestamp_micros(F.lit(grid.origin) + F.shiftright("key", 1) * F.lit(grid.step))
    return found.withColumn("t_end", end).drop("key")


# --- percentiles over panes ---------------------------------------------------

def percentile_over(rows: DataFrame, keys: list[str], value: str, p: float, windows: DataFrame, name: str,
                    again: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(keys, slot, name): the exact interpolated percentile of every window.

    ``rows``: keys, pane and value. ``windows``: (pane, slot), the panes of each window. Counts by pane and logarithmic
    bucket are added up for the windows, which gives the bucket or two that hold the ranks; only the samples of those
    are read again, counted by value, and added up likewise. Where the counts are kept, ``counted`` (keys, pane, _b,
    _n, _least, _most) spares the first pass; ``again`` are the rows of the second, if they are others.
    """
    groups = key_names(keys)
    windows = small_side(windows)

    def prepared(df: DataFrame) -> DataFrame:
        return (with_keys(df.filter(col(value).isNotNull()), keys)
                .select(*groups, *keys, "pane", col(value).cast("double").alias("_v"))
                .withColumn("_b", log_bucket(col("_v"))))

    if counted is None:
        counted = pane_buckets(rows, keys, value)
    buckets = (with_keys(counted, keys).join(windows, "pane").groupBy(*groups, "slot", "_b")
               .agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most")))
    targets = target_buckets(buckets, [*groups, "slot"], p).drop("_least", "_most")
    targets = small_side(targets)
    wanted = small_side(targets.select(*groups, "_b").distinct())
    values = (prepared(rows if again is None else again).join(wanted, [*groups, "_b"])
              .groupBy(*groups, *keys, "pane", "_b", "_v").agg(F.count("*").alias("_n")))
    ranks = ["_pos", "_lo", "_hi"]
    found = (values.join(windows, "pane").join(targets, [*groups, "slot", "_b"])
             .groupBy(*groups, *keys, "slot", "_v", *ranks)
             .agg(F.sum("_n").alias("_n"), F.min("_before").alias("_before")))
    return ranked_values(found, [*groups, "slot"], [*keys, "slot"], name)


def pane_buckets(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, pane, _b, _n, _least, _most): counts by logarithmic bucket, the mergeable part of a percentile."""
    v = col(value).cast("double")
    return (rows.filter(v.isNotNull()).groupBy(*keys, "pane", log_bucket(v).alias("_b"))
            .agg(F.count("*").alias("_n"), F.min(v).alias("_least"), F.max(v).alias("_most")))


def sweep_latency(metrics: DataFrame, cfg: Thresholds, points: list[Instant]) -> DataFrame:
    """(asof, t_end, app, p95_recent, p95_base) at many instants, as ``app_latency`` gives, from two passes."""
    spark = metrics.sparkSession
    grid = common_grid(points, cfg)
    start, base_end = points[0].start, points[0].start + cfg.baseline_min * cfg.unit_us
    pre = (col("ts") >= at(start)) & (col("ts") < at(base_end))
    # A pane of percentiles is a half pane, and whether it is of the fixed baseline.
    pane = grid.half(F.unix_micros("ts")) * 2 + F.when(pre, 1).otherwise(0)
    rows = _prefilter(metrics, points, heap=False).select("app", pane.alias("pane"), "app_latency_ms")
    ends = sorted({p.base_hi for p in points})
    spans = [(i, 4 * (grid.number(p.end) // 2 - grid.recent) + 2, 2 * grid.number(p.end) + 1, 1) for i, p in enumerate(points)]
    low = grid.number(start)
    # Up to its end, exclusive; the fixed one ends where `pre` does.
    spans += [(len(points) + j, 2 * low + 1, 2 * grid.number(hi if hi == base_end else hi - 1) + 1, 2) for j, hi in enumerate(ends)]
    spans = [s for s in spans if s[1] <= s[2]]
    windows = spark.createDataFrame(spans, "slot int, low long, high long, by long").select(
        "slot", F.explode(F.sequence("low", "high", "by")).alias("pane"))
    p95 = percentile_over(rows, ["app"], "app_latency_ms", 0.95, windows, "p95")
    users = [(i, i, True) for i in range(len(points))]
    users += [(len(points) + ends.index(p.base_hi), i, False) for i, p in enumerate(points)]
    table = spark.createDataFrame([(slot, points[i].asof, points[i].end, now) for slot, i, now in users],
                                  "slot int, asof double, end long, now boolean")
    return (p95.join(F.broadcast(table), "slot")  # two rows for each instant
            .groupBy("asof", "end", "app").agg(
                F.max(F.when(col("now"), col("p95"))).alias("p95_recent"), F.max(F.when(~col("now"), col("p95"))).alias("p95_base"))
            .select("asof", F.timestamp_micros("end").alias("t_end"), "app", "p95_recent", "p95_base"))
