"""Panes: windows merged from moments equal windows over samples."""

import pytest
from pyspark.sql import functions as F

from fleetlens.config import Thresholds
from fleetlens.operators import panes
from fleetlens.operators.features import app_latency, vm_features
from fleetlens.operators.windows import instants
from fleetlens.plans.detect import replay, sweep
from tests import fleet

CFG = Thresholds()
MIX = [*fleet.MIX, ("app_latency_ms", "postgres-db", 3, 40, 300.0, 0)]


@pytest.fixture(scope="module")
def metrics(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panes") / "m")
    rows = fleet.metrics(spark, incidents=MIX)
    odd = fleet.rows(spark, [
        {"minute": 20, "vm_id": None, "heap_mb": 5.0}, {"minute": 60.01, "vm_id": "late", "heap_mb": 7.0, "disk_iops": 3.0},
        {"minute": 60.01, "vm_id": "late", "app": None}, {"minute": 30, "vm_id": "edge", "disk_io_await_ms": 4.0},
        {"minute": 29.9, "vm_id": "edge", "disk_io_await_ms": 9.0}, {"minute": 3, "vm_id": "old", "error_rate_pct": 9.0},
        *[{"minute": m, "vm_id": "flat", "heap_mb": 10.0} for m in range(50, 80)]])
    rows.unionByName(odd).coalesce(3).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def rounded(df):
    out = []
    for row in df.collect():
        out.append(tuple(f"{x:.6f}".replace("-0.000000", "0.000000") if isinstance(x, float) else x for x in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("asofs", [[0.0], [0.0, 5.0, 45.0, 60.0, 79.5, 85.0], [x / 2 for x in range(0, 150, 7)], [0.0, 0.35, 17.25]])
def test_sweep_features_equal_windows_over_samples(metrics, asofs):
    points = instants(metrics, CFG, asofs)
    columns = ["asof", "t_end", "vm_id", "app_recent", "app_heap", "n_recent", "io_recent", "retrans_recent", "err_recent",
               "iops_now", "n_heap", "heap_now", "heap_slope", "heap_corr", "n_base", "io_base", "io_base_std", "err_base"]
    want = vm_features(metrics, CFG, points).filter("n_recent > 0 OR n_heap > 0 OR n_base > 0")
    assert rounded(panes.sweep_features(metrics, CFG, points).select(columns)) == rounded(want.select(columns))


@pytest.mark.parametrize("asofs", [[0.0], [0.0, 5.0, 45.0, 60.0, 79.5, 85.0], [x / 2 for x in range(0, 150, 11)]])
def test_sweep_percentiles_equal_windows_over_samples(metrics, asofs):
    points = instants(metrics, CFG, asofs)
    columns = ["asof", "t_end", "app", "p95_recent", "p95_base"]
    want = app_latency(metrics, CFG, points).filter("p95_recent IS NOT NULL OR p95_base IS NOT NULL")
    assert rounded(panes.sweep_latency(metrics, CFG, points).select(columns)) == rounded(want.select(columns))


def test_sweep_gives_the_alerts_of_replay(metrics):
    asofs = [0.0, 10.0, 15.0, 22.5, 30.0, 45.0, 70.0]
    found, want = (rounded(f(metrics, CFG, asofs).drop("evidence_json")) for f in (sweep, replay))
    assert len({r[3] for r in want}) == 5 and found == want


def test_the_number_of_instants_changes_neither_scans_nor_shuffles(metrics):
    def nodes(count):
        points = instants(metrics, CFG, [x / 2 for x in range(count)])
        text = panes.sweep_features(metrics, CFG, points)._jdf.queryExecution().executedPlan().toString()
        return [text.count(x) for x in ("FileScan", "Exchange", "Expand", "Generate")]

    assert nodes(2) == nodes(170)


def test_grid_numbers_both_kinds_of_instants(spark):
    grid = panes.Grid(origin=1_000, step=10, recent=1, heap=3)
    values = [1_000, 995, 990, 985, 1_001, 1_010, -7]
    rows = spark.createDataFrame([(v,) for v in values], "us long").select("us", grid.half(F.col("us")).alias("key")).collect()
    assert [(r.us, r.key) for r in rows] == [(v, grid.number(v)) for v in values]
    assert [grid.number(v) for v in (1_000, 995, 990, 1_001)] == [0, -1, -2, 1]
