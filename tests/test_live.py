from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens import schema
from fleetlens.config import Thresholds
from fleetlens.operators.features import app_latency
from fleetlens.operators.windows import instants
from fleetlens.plans.detect import replay
from fleetlens.streaming import live
from tests import fleet

CFG = Thresholds()
MIX = [*fleet.MIX, ("app_latency_ms", "postgres-db", 3, 40, 300.0, 0)]
# Samples end at 89.5 minutes, and the watermark is a minute behind: windows up to minute 88 are closed.
ENDS = [x / 2 for x in range(4, 180)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("live") / "in")
    fleet.metrics(spark, incidents=MIX).coalesce(2).write.parquet(path)
    return path, spark.read.schema(schema.VM_METRICS).parquet(path)


def stream_of(spark, path):
    return spark.readStream.schema(schema.VM_METRICS).parquet(path)


def key(rows):
    return sorted((r.ts, r.severity, r.rule, r.vm_id, r.app, r.headline, r.action) for r in rows)


def batch_alerts(metrics, asofs, rule):
    """Detection at each of the last ends against the baseline of the newest instant, as the live rules have it."""
    points = instants(metrics, CFG, asofs)
    late = [p.asof for p in points if p.base_hi == points[0].base_hi]  # they share the baseline
    return late, key(replay(metrics, CFG, late).filter(rule).collect())


def test_live_alerts_equal_batch_detection(spark, stored, tmp_path):
    path, metrics = stored
    baseline = live.vm_baseline(metrics, instants(metrics, CFG)[0])
    query = live.watch_vms(stream_of(spark, path), baseline, str(tmp_path), CFG)
    query.awaitTermination()
    late, want = batch_alerts(metrics, [0.0, *ENDS[:60:5]], "rule <> 'apm_latency'")
    ends = [fleet.START + timedelta(minutes=89.5 - x) for x in late if x >= 1.5]
    want = [r for r in want if r[0].timestamp() in {e.timestamp() for e in ends}]
    found = live.live_alerts(spark, str(tmp_path)).filter(
        F.unix_micros("ts").isin([int(e.timestamp() * 1e6) for e in ends])).collect()
    assert len({r[2] for r in want}) == 4 and key(found) == want


def test_the_state_holds_one_row_for_a_pane(spark, stored, tmp_path):
    path, metrics = stored
    query = live.watch_vms(stream_of(spark, path), live.vm_baseline(metrics, instants(metrics, CFG)[0]), str(tmp_path), CFG)
    query.awaitTermination()
    panes = metrics.select("vm_id", "app", F.ceil(F.unix_micros("ts") / 30_000_000)).distinct().count()
    assert sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress) == panes
    stored_panes = spark.read.parquet(f"{tmp_path}/panes")
    assert stored_panes.count() == stored_panes.select("vm_id", "app", "key").distinct().count() <= panes


def test_live_latency_equals_batch_detection(spark, stored, tmp_path):
    path, metrics = stored
    baseline = live.app_baseline(app_latency(metrics, CFG, instants(metrics, CFG)))
    live.watch_latency(stream_of(spark, path), lambda: metrics, baseline, str(tmp_path), CFG).awaitTermination()
    late, want = batch_alerts(metrics, [x for x in ENDS[:60:3] if x >= 1.5], "rule = 'apm_latency'")
    ends = [int((fleet.START + timedelta(minutes=89.5 - x)).timestamp() * 1e6) for x in late]
    found = live.live_alerts(spark, str(tmp_path)).filter(F.unix_micros("ts").isin(ends)).collect()
    assert want and key(found) == want


def test_late_samples_do_not_reopen_windows(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    no_baseline = spark.createDataFrame(
        [], "vm_id string, n_base long, io_base double, io_base_std double, err_base double")

    def step(minutes, vm):
        samples = fleet.rows(spark, [{"minute": x, "vm_id": vm, "net_retrans_pct": 9} for x in minutes])
        samples.coalesce(1).write.mode("append").parquet(path)
        live.watch_vms(stream_of(spark, path), no_baseline, folder, CFG, slide_s=600).awaitTermination()
        return live.live_alerts(spark, folder)

    first = step(range(0, 41), "on-time")
    assert {r.vm_id for r in first.collect()} == {"on-time"}
    before = first.count()
    assert step([5], "late").count() == before
    # the stream goes on: newer samples close newer windows, also of what has been silent since
    assert step(range(41, 61), "next").count() > before
    last = step(range(61, 100), "next").collect()
    assert len(last) == len({(r.ts, r.vm_id) for r in last})
    silent = [r.ts for r in last if r.vm_id == "on-time"]
    assert max(silent).minute == 40  # its last sample: windows are open at their start


def test_windows_are_whole_slides():
    grid = live.live_grid(CFG, 600)
    assert (grid.recent, grid.heap) == (1, 3)
    with pytest.raises(ValueError):
        live.live_grid(CFG, 420)


def test_nothing_written_is_no_alert(spark, tmp_path):
    assert live.live_alerts(spark, str(tmp_path / "none")).count() == 0
