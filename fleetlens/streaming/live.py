"""Live detection on a stream of samples.

Samples are added up by pane (one slide) in the stream's state, and a pane is emitted once, when the
watermark has passed its end: the state holds open panes, and no sample is copied for the windows it lies in.
Each micro-batch stores its panes by day and puts together the windows that they close, from the panes of
the last window length. A pane ends at a window's end, closed there and open at its start; a
streaming window is the other way round, so event time is shifted back by one microsecond.

The app-level p95 rule keeps counts by logarithmic bucket for each app and pane. They tell the bucket that holds the
percentile's rank; only the samples of that bucket are then read from the lake again, so results are exact.
(Samples behind the watermark are in no count; such that have landed and lie in that very bucket shift its ranks.)

Panes and alerts of a micro-batch are written under its id and replaced when it is repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.config import Thresholds
from fleetlens.functions.sizing import small_side
from fleetlens.operators.history import time_bounds
from fleetlens.operators.panes import MOMENTS, Grid, live_grid, moments, pane_buckets, percentile_over, rolled
from fleetlens.operators.rules import RULES, alerts_from
from fleetlens.operators.windows import Instant, between
from fleetlens.plans.detect import detect
from fleetlens.schema import ALERTS
from fleetlens.sources.sinks import append_alerts
from fleetlens.sources.tables import read_lake
from fleetlens.streaming.ingest import read_ledger, table_path

VM_RULES = ["heap_leak", "io_spike", "net_retrans", "error_storm"]
APP_RULES = ["apm_latency"]


def vm_baseline(metrics: DataFrame, point: Instant) -> DataFrame:
    """Baseline statistics per VM, to be stored and joined to the live windows."""
    io = F.col("disk_io_await_ms").cast("double")
    return (between(metrics, lo=point.start, hi=point.base_hi - 1).filter(F.col("vm_id").isNotNull())
            .groupBy("vm_id").agg(
                F.count("*").alias("n_base"), F.avg(io).alias("io_base"),
                F.stddev_samp(io).alias("io_base_std"),
                F.avg(F.col("error_rate_pct").cast("double")).alias("err_base")))


def app_baseline(latency: DataFrame) -> DataFrame:
    """(app, p95_base) of a frame of ``app_latency``, to be stored and joined to the live windows."""
    return latency.select("app", "p95_base")


def _paned(stream: DataFrame, slide_s: float, watermark: str) -> DataFrame:
    return (stream.withColumn("_at", F.timestamp_micros(F.unix_micros("ts") - 1)).withWatermark("_at", watermark)
            .withColumn("pane", F.window("_at", f"{int(slide_s)} seconds")))


def _index(end: Column, grid: Grid) -> Column:
    """The number of the pane that ends at a time."""
    return F.floor(F.unix_micros(end) / F.lit(grid.step)).cast("long")


def vm_pane_stream(stream: DataFrame, cfg: Thresholds, slide_s: float, watermark: str) -> DataFrame:
    """(vm_id, app, key, moments) of every closed pane. The app is a key, so the aggregation stays hash-based."""
    grid = live_grid(cfg, slide_s)
    return (_paned(stream, slide_s, watermark).groupBy("pane", "vm_id", "app")
            .agg(*moments(F.unix_micros("pane.end"), cfg))
            .select("vm_id", "app", (_index(F.col("pane.end"), grid) * 2).alias("key"), *MOMENTS))


def latency_pane_stream(stream: DataFrame, cfg: Thresholds, slide_s: float, watermark: str) -> DataFrame:
    """(app, key, _b, _n, _least, _most): latency counts by bucket of every closed pane."""
    grid = live_grid(cfg, slide_s)
    counted = pane_buckets(_paned(stream, slide_s, watermark), ["app"], "app_latency_ms")
    return counted.select("app", (_index(F.col("pane.end"), grid) * 2).alias("key"), "_b", "_n", "_least", "_most")


class _Store:
    """Closed panes by day and micro-batch; reading looks at the days of one window length only."""

    def __init__(self, path: str, grid: Grid):
        self.path, self.grid = path, grid

    def day(self, key: Column) -> Column:
        return F.date_format(F.to_date(F.timestamp_micros(F.shiftright(key, 1) * F.lit(self.grid.step))), "yyyy-MM-dd")

    def write(self, panes: DataFrame, batch_id: int) -> tuple[int, int] | None:
        """The first and the last pane end of a batch, once its panes are stored."""
        (panes.withColumns({"day": self.day(F.col("key")), "batch": F.lit(batch_id).cast("long")})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path))
        row = panes.agg(F.min("key"), F.max("key")).first()
        return None if row[0] is None else (row[0] // 2, row[1] // 2)

    def recent(self, panes: DataFrame, batch_id: int, first: int, last: int) -> tuple[DataFrame, int]:
        """The panes that windows from ``first`` to ``last`` are made of, and the last end of earlier batches (or first - 1)."""
        low = first - self.grid.longest
        days = sorted({datetime.fromtimestamp(i * self.grid.step / 1e6, timezone.utc).strftime("%Y-%m-%d")
                       for i in range(low, last + 1)})
        spark = panes.sparkSession
        stored = (spark.read.schema(panes.schema.add("day", "string").add("batch", "long")).parquet(self.path)
                  .filter(F.col("day").isin(days) & (F.col("batch") <= batch_id) & (F.col("key") > 2 * low)))
        before = stored.filter(F.col("batch") < batch_id).agg(F.max("key")).first()[0]
        return stored.drop("day", "batch"), (first - 1 if before is None else before // 2)


def _marks(panes: DataFrame, grid: Grid, after: int, last: int) -> DataFrame:
    """(vm_id, key): the window ends in (after, last] that hold a pane of the VM."""
    order = Window.partitionBy("vm_id").orderBy("i")
    known = panes.select("vm_id", F.shiftright("key", 1).alias("i")).distinct()
    following = F.coalesce(F.lead("i").over(order) - 1, F.lit(last).cast("long"))
    low = F.greatest("i", F.lit(after + 1).cast("long"))
    high = F.least(following, F.col("i") + grid.longest - 1, F.lit(last).cast("long"))
    return (known.select("vm_id", low.alias("low"), high.alias("high")).filter("low <= high")
            .select("vm_id", F.explode(F.sequence("low", "high")).alias("i")).select("vm_id", (F.col("i") * 2).alias("key")))


def _alerts(features: DataFrame, cfg: Thresholds, names: list[str], grid: Grid) -> DataFrame:
    ready = features.withColumns({"asof": F.lit(0.0), "t_end": F.timestamp_micros(
        F.shiftright(F.col("key"), 1) * F.lit(grid.step))})
    return alerts_from(ready, cfg, [RULES[name] for name in names]).select(*ALERTS.names)


def vm_alerts(panes: DataFrame, marks: DataFrame, baseline: DataFrame, cfg: Thresholds, grid: Grid, last: int) -> DataFrame:
    """Alerts of the per-VM rules at the marked window ends."""
    ready = panes.withColumn("pre", F.lit(False))
    found = rolled(ready, marks, cfg, grid, last).drop("n_base", "io_base", "io_base_std", "err_base")
    joined = found.join(small_side(baseline), "vm_id", "left").withColumn("n_base", F.coalesce("n_base", F.lit(0)))
    return _alerts(joined, cfg, VM_RULES, grid)


def latency_alerts(counts: DataFrame, samples: DataFrame, baseline: DataFrame, cfg: Thresholds, grid: Grid, after: int,
                   last: int) -> DataFrame:
    """Alerts of the app p95 rule at the window ends in (after, last]; ``samples`` are read for the target buckets only."""
    spark = samples.sparkSession
    windows = spark.range(after + 1, last + 1).select(
        (F.col("id") * 2).alias("slot"), F.explode(F.sequence(F.col("id") - (grid.recent - 1), F.col("id"))).alias("pane"))
    span = between(samples, lo=(after + 1 - grid.recent) * grid.step + 1, hi=last * grid.step)
    pane = F.shiftright(grid.half(F.unix_micros("ts")) + 1, 1)
    rows = span.select("app", pane.alias("pane"), "app_latency_ms")
    p95 = percentile_over(rows, ["app"], "app_latency_ms", 0.95, windows, "p95_recent",
                          counted=counts.withColumn("pane", F.shiftright("key", 1)).drop("key"))
    joined = p95.withColumnRenamed("slot", "key").join(small_side(baseline), "app")
    return _alerts(joined, cfg, APP_RULES, grid)


def _started(panes: DataFrame, folder: str, grid: Grid, found: Callable[[DataFrame, int, int], DataFrame],
             checkpoint: str, trigger: dict) -> StreamingQuery:
    store = _Store(f"{folder}/panes", grid)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # written, and asked for its ends
        try:
            ends = store.write(batch, batch_id)
            if ends is None:
                return
            rows, after = store.recent(batch, batch_id, *ends)
            (found(rows, after, ends[1]).withColumn("batch", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/alerts"))
        finally:
            batch.unpersist()

    return (panes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)
            .trigger(**trigger).start())


def watch_vms(stream: DataFrame, baseline: DataFrame, folder: str, cfg: Thresholds, slide_s: float = 30,
              watermark: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Start the per-VM rules on a stream; panes and alerts go below ``folder``. ``baseline`` is a stored table."""
    grid = live_grid(cfg, slide_s)

    def found(panes: DataFrame, after: int, last: int) -> DataFrame:
        return vm_alerts(panes, _marks(panes, grid, after, last), baseline, cfg, grid, last)

    return _started(vm_pane_stream(stream, cfg, slide_s, watermark), folder, grid, found, f"{folder}/checkpoint",
                    trigger or {"availableNow": True})


def watch_latency(stream: DataFrame, samples: Callable[[], DataFrame], baseline: DataFrame, folder: str, cfg: Thresholds,
                  slide_s: float = 30, watermark: str = "1 minute", trigger: dict | None = None) -> StreamingQuery:
    """Start the app p95 rule on a stream; ``samples`` opens the table in which its samples have landed."""
    grid = live_grid(cfg, slide_s)

    def found(counts: DataFrame, after: int, last: int) -> DataFrame:
        return latency_alerts(counts, samples(), baseline, cfg, grid, after, last)

    return _started(latency_pane_stream(stream, cfg, slide_s, watermark), folder, grid, found, f"{folder}/checkpoint",
                    trigger or {"availableNow": True})


def live_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts that a watched stream has written."""
    try:
        return spark.read.schema(ALERTS).parquet(f"{folder}/alerts")
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], ALERTS)


def detect_on_commit(spark: SparkSession, lake: str, alerts_path: str, cfg: Thresholds) -> Callable[[int], None]:
    """A hook for ``ingest_stream``: full detection as of the newest sample after
    each batch. A repeated batch replaces the alerts of its instant."""
    def run(batch_id: int) -> None:
        bounds = time_bounds(read_ledger(spark, lake))
        if bounds:
            metrics = read_lake(spark, table_path(lake, "vm_metrics"), "vm_metrics")
            append_alerts(detect(metrics, cfg, bounds=bounds, ordered=False), alerts_path, replace_instant=True,
                          instant=datetime.fromtimestamp(bounds.end / 1e6, timezone.utc))

    return run
