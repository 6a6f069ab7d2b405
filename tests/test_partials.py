"""Interval joins by bins, stored partials and sketches, and files laid out for single VMs."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens import schema
from fleetlens.config import Thresholds
from fleetlens.operators import health, intervals, quality, sketches
from fleetlens.sources.tables import read_lake
from fleetlens.streaming import ingest
from tests import fleet


def _pairs(points, spans):
    return sorted((k, t, i) for k, t in points for key, i, a, b in spans if k is not None and k == key and a <= t < b)


def _joined(spark, points, spans):
    found = intervals.interval_join(
        spark.createDataFrame(points, "k string, t long"), spark.createDataFrame(spans, "k string, i int, a long, b long"),
        ["k"], F.col("t"), F.col("a"), F.col("b"))
    assert found.columns == ["k", "t", "i", "a", "b"]
    return sorted((r.k, r.t, r.i) for r in found.collect())


def test_interval_join_equals_pairs(spark):
    rng = random.Random(4)
    keys = ["a", "a", "a", "b", None]
    points = [(rng.choice(keys), rng.randint(-500, 2_000)) for _ in range(400)]
    spans = []
    for i in range(200):
        a = rng.randint(-400, 1_900)
        spans.append((rng.choice(keys), i, a, a + rng.choice([-5, 0, 1, 2, 3, 16, 17, 100, 1_023, 1_024, 1_025, 5_000])))
    assert _joined(spark, points, spans) == _pairs(points, spans)
    assert _joined(spark, points, []) == [] and _joined(spark, [], spans) == []


def test_a_hot_vm_is_no_product_of_samples_and_incidents(spark):
    # One VM with 10,000 incidents of 60 microseconds and 100,000 samples, at both sides of the broadcast bound.
    points = spark.range(100_000).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("t"))
    spans = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("i"), (F.col("id") * 100).alias("a"),
                                       (F.col("id") * 100 + 60).alias("b"))
    found = intervals.interval_join(points, spans, ["k"], F.col("t"), F.col("a"), F.col("b"))
    assert found.count() == 60_000  # six samples in each
    bins = intervals.binned(spans, F.col("a"), F.col("b"))
    level, = [r[0] for r in bins.select("_level").distinct().collect()]
    met = points.withColumn("_bin", F.expr(f"shiftright(t, {level})")).join(bins, ["k", "_bin"]).count()
    assert met < 4 * 60_000
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "_bin" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_labels_of_overlapping_incidents(spark):
    m = fleet.rows(spark, [{"minute": x} for x in range(10)])
    ts = [r.ts for r in m.orderBy("ts").collect()]
    incidents = spark.createDataFrame([("one", "vm-0", ts[2], ts[5]), ("two", "vm-0", ts[4], ts[8]), ("none", "vm-0", ts[4], ts[4]),
                                       ("other", "vm-9", ts[0], ts[9])], "incident string, vm_id string, start_ts timestamp, end_ts timestamp")
    found = quality.label_incidents(m, incidents)
    assert found.columns == [*m.columns, "incident", "elapsed_min"]
    assert sorted((r.incident, ts.index(r.ts), r.elapsed_min) for r in found.collect()) == [
        ("one", 2, 0.0), ("one", 3, 1.0), ("one", 4, 2.0), ("two", 4, 0.0), ("two", 5, 1.0), ("two", 6, 2.0), ("two", 7, 3.0)]


@pytest.fixture
def lake(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(ingest.SKIPPING, "parquet.block.size", "60000")
    m = fleet.metrics(spark, n_samples=240, fleet={"big": 150, "small": 5})
    m.repartition(1).write.parquet(f"{tmp_path}/raw/vm_metrics/chunk=0")
    ingest.ingest_once(spark, f"{tmp_path}/raw", f"{tmp_path}/lake")
    return f"{tmp_path}/lake", m


def _rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_vm_reads_a_few_row_groups(spark, lake):
    path, m = lake
    table = read_lake(spark, f"{path}/vm_metrics", "vm_metrics")
    total = table.count()
    one = table.filter("vm_id = 'big-0042'").select("ts", "heap_mb", "vm_id")
    assert one.count() == 240 and _rows_scanned(one) < total / 5
    assert _rows_scanned(table.filter("vm_id = 'big-00420'").select("ts", "vm_id")) < total / 5


def test_partials_are_the_fleet(spark, lake):
    path, m = lake
    before = sorted(map(tuple, health.vm_list(m).collect()))
    found = ingest.read_partials(spark, path)
    assert sorted((r.vm_id, r.app, r.n_samples) for r in found.collect()) == before
    none = spark.createDataFrame([], schema.ALERTS)
    assert health.kpis(found, none).first() == health.kpis(m, none).first()
    assert "ts_day" not in found._jdf.queryExecution().executedPlan().toString()  # the table is not read
    # A batch that has not been committed does not count.
    (found.withColumns({"table": F.lit("vm_metrics"), "batch_id": F.lit(77).cast("long")})
     .write.mode("append").partitionBy("table", "batch_id").parquet(ingest.partials_path(path)))
    assert ingest.create(spark, f"{path}/_ingest/claims/vm_metrics/77", "somebody 0")
    assert sorted((r.vm_id, r.app, r.n_samples) for r in ingest.read_partials(spark, path).collect()) == before
    assert ingest.read_partials(spark, f"{path}-none").count() == 0


def test_partials_follow_batches(spark, tmp_path):
    for i, minutes in enumerate((range(5), range(5, 12))):
        fleet.rows(spark, [{"minute": x, "vm_id": f"vm-{x % 2}"} for x in minutes]).coalesce(1).write.parquet(
            f"{tmp_path}/raw/vm_metrics/chunk={i}")
        ingest.ingest_once(spark, f"{tmp_path}/raw", f"{tmp_path}/lake")
    now = {r.vm_id: r.n_samples for r in ingest.read_partials(spark, f"{tmp_path}/lake").collect()}
    then = {r.vm_id: r.n_samples for r in ingest.read_partials(spark, f"{tmp_path}/lake", as_of_batch=0).collect()}
    assert now == {"vm-0": 6, "vm-1": 6} and then == {"vm-0": 3, "vm-1": 2}


def test_sketches_keep_their_bounds_when_merged(spark):
    m = fleet.metrics(spark, n_samples=3_000, fleet={"big": 12, "small": 2})
    m = m.withColumn("ts", F.expr("timestampadd(HOUR, pmod(hash(ts), 200), ts)"))
    daily = sketches.daily(m)
    found = sketches.answers(daily)
    for row in sketches.rank_errors(m, found).collect():
        assert row.rank_error <= 0.02 and row.vm_error <= 0.04
    assert {(r.app, r.n) for r in found.collect()} == {("big", 36_000), ("small", 6_000)}
    assert sketches.answers(sketches.daily(m.limit(0))).count() == 0
