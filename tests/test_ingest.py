import datetime as dt
import os

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetlens import schema
from fleetlens.config import Thresholds
from fleetlens.operators import history
from fleetlens.operators.windows import data_bounds
from fleetlens.plans.detect import detect
from fleetlens.sources import sinks, tables
from fleetlens.streaming import ingest, live
from tests import fleet


def chunk(root, table, name, times, unit="us", vm="vm-0"):
    folder = os.path.join(root, table, "dt=2026-01-01", "hour=08")
    os.makedirs(folder, exist_ok=True)
    ts = pd.to_datetime(times).astype(f"datetime64[{unit}]")
    frame = pd.DataFrame({"ts": ts, "vm_id": [vm] * len(times)})
    typed = pa.schema([("ts", pa.timestamp(unit)), ("vm_id", pa.string())])
    pq.write_table(pa.Table.from_pandas(frame, schema=typed, preserve_index=False), os.path.join(folder, name))


@pytest.fixture
def dirs(tmp_path):
    return str(tmp_path / "raw"), str(tmp_path / "lake")


def rows(spark, lake, table="vm_metrics"):
    return tables.read_lake(spark, ingest.table_path(lake, table), table)


def test_each_chunk_lands_once(spark, dirs):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    chunk(raw, "app_events", "a.parquet", ["2026-01-01 08:01"])
    assert sorted((r.table, r.rows) for r in ingest.ingest_once(spark, raw, lake).collect()) == [
        ("app_events", 1), ("vm_metrics", 1)]
    assert ingest.ingest_once(spark, raw, lake).count() == 0
    chunk(raw, "vm_metrics", "b.parquet", ["2026-01-01 09:00", "2026-01-02 09:00"])
    added, = ingest.ingest_once(spark, raw, lake).collect()
    assert (added.table, added.rows, added.file_path.endswith("b.parquet")) == ("vm_metrics", 2, True)
    got = rows(spark, lake)
    assert got.count() == 3 and rows(spark, lake, "app_events").count() == 1
    # the day comes from ts, not from the folder the chunk was filed under
    assert {str(r.ts_day) for r in got.collect()} == {"2026-01-01", "2026-01-02"}
    assert tables.read_lake(spark, f"{lake}/vm_metrics", "vm_metrics", as_of_batch=0).count() == 1


def test_empty_chunk_is_recorded_but_adds_nothing(spark, dirs):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    chunk(raw, "vm_metrics", "b.parquet", [])
    counts = {os.path.basename(r.file_path): r.rows for r in ingest.ingest_once(spark, raw, lake).collect()}
    assert counts == {"a.parquet": 1, "b.parquet": 0}
    assert ingest.ingest_once(spark, raw, lake).count() == 0
    assert rows(spark, lake).count() == 1
    assert history.table_sizes(ingest.read_ledger(spark, lake)).first().n_batches == 1


def test_only_empty_chunks(spark, dirs):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", [])
    assert [r.rows for r in ingest.ingest_once(spark, raw, lake).collect()] == [0]
    assert rows(spark, lake).count() == 0


def test_nanosecond_chunks(spark, dirs):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00:00.123456789"], unit="ns")
    ingest.ingest_once(spark, raw, lake)
    us = rows(spark, lake).select(F.unix_micros("ts")).first()[0]
    assert us == int(pd.Timestamp("2026-01-01 08:00:00.123456").value // 1000)
    read = tables.read_chunks(spark, f"{raw}/vm_metrics", "vm_metrics")
    assert read.schema == schema.VM_METRICS
    assert read.select(F.unix_micros("ts")).first()[0] == us


def test_one_batch_per_chunk_and_history(spark, dirs):
    raw, lake = dirs
    for i in range(12):
        chunk(raw, "vm_metrics", f"{i:02d}.parquet", ["2026-01-01 08:00"] * (i + 1))
    ingest.ingest_stream(spark, raw, lake, "vm_metrics", max_files=1).awaitTermination()
    ledger = ingest.read_ledger(spark, lake)
    assert history.batches(ledger).count() == 12
    last = history.last_batches(ledger).orderBy("batch_id").collect()
    assert [r.batch_id for r in last] == list(range(2, 12))
    assert last[-1].total == 78 and last[0].previous_total + last[0].added == last[0].total
    assert [a.total for a in last[:-1]] == [b.previous_total for b in last[1:]]
    assert history.time_bounds(ledger).n_rows == 78


def test_repeated_batch_replaces_itself(spark, dirs):
    """A crash after the data was written and before the ledger was."""
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00", "2026-01-02 08:00"])
    raw_rows = (spark.read.option("recursiveFileLookup", "true").parquet(f"{raw}/vm_metrics")
                .select("*", F.col("_metadata.file_path").alias("_source_file")))
    for _ in range(2):
        ingest.commit(spark, lake, "vm_metrics", raw_rows, "s", 0)
    assert rows(spark, lake).count() == 2
    assert [r.rows for r in ingest.read_ledger(spark, lake).collect()] == [2]


def test_new_checkpoint_does_not_load_chunks_again(spark, dirs, monkeypatch):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    ingest.ingest_once(spark, raw, lake)
    # the checkpoint is lost, the lake is not
    os.rename(f"{lake}/_ingest/checkpoint", f"{lake}/_ingest/lost")
    chunk(raw, "vm_metrics", "b.parquet", ["2026-01-01 09:00"])
    added = ingest.ingest_once(spark, raw, lake).collect()
    assert [os.path.basename(r.file_path) for r in added] == ["b.parquet"]
    assert rows(spark, lake).count() == 2
    assert sorted(r.batch_id for r in ingest.read_ledger(spark, lake).collect()) == [0, 1]


def test_files_and_stream_share_the_ledger(spark, dirs):
    raw, lake = dirs
    for name in ("a", "b", "c"):
        chunk(raw, "vm_metrics", f"{name}.parquet", ["2026-01-01 08:00"])
    assert ingest.ingest_files(spark, raw, lake, "vm_metrics", max_files=2) == 2
    assert ingest.ingest_once(spark, raw, lake).count() == 0
    assert rows(spark, lake).count() == 3


def test_routing_by_path(spark):
    df = spark.createDataFrame(
        [("vm_metrics/dt=x/p.parquet",), ("app_events/dt=x/p.parquet",), ("something/else.parquet",),
         ("s3://b/raw/vm_metrics/dt=x/p.parquet",), ("raw\\app_events\\p.parquet",),
         ("app_events/vm_metrics/p.parquet",)], "path string")
    assert [r[0] for r in df.select(tables.table_of(F.col("path"))).collect()] == [
        "vm_metrics", "app_events", None, "vm_metrics", "app_events", "app_events"]


def test_a_root_named_like_a_table_does_not_misroute(spark, tmp_path):
    raw = str(tmp_path / "app_events" / "raw")
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    chunk(raw, "app_events", "a.parquet", ["2026-01-01 08:00"])
    found = tables.list_chunks(spark, raw).collect()
    assert sorted((r.table, f"/raw/{r.table}/" in r.file_path) for r in found) == [
        ("app_events", True), ("vm_metrics", True)]
    lake = str(tmp_path / "lake")
    assert sorted(r.table for r in ingest.ingest_once(spark, raw, lake).collect()) == ["app_events", "vm_metrics"]


def test_watch_mode_and_detection_after_each_batch(spark, dirs, tmp_path):
    raw, lake = dirs
    alerts = str(tmp_path / "alerts")
    m = fleet.metrics(spark, incidents=fleet.MIX)
    sinks.write_chunks(m, raw, "vm_metrics")
    cfg = Thresholds()
    query = ingest.ingest_stream(spark, raw, lake, "vm_metrics", watch_seconds=1,
                                 on_commit=live.detect_on_commit(spark, lake, alerts, cfg))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark, lake).count() == m.count()
    want = detect(m, cfg).collect()
    assert want and sorted(map(tuple, sinks.read_alerts(spark, alerts).collect())) == sorted(map(tuple, want))


def test_lake_reads_prune_days(spark, dirs):
    raw, lake = dirs
    days = [f"2026-01-{d:02d} 08:00" for d in range(1, 11)]
    for i, day in enumerate(days):
        chunk(raw, "vm_metrics", f"{i}.parquet", [day])
    ingest.ingest_once(spark, raw, lake)
    got = rows(spark, lake)
    assert data_bounds(got).end == int(pd.Timestamp(days[-1]).value // 1000)
    from fleetlens.operators.windows import between
    plan = between(got, lo=data_bounds(got).end)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ts_day" in plan
    assert "ts_day" in plan and "2026-01-10" in plan


def test_sources(spark, dirs, tmp_path):
    raw, _ = dirs
    frames = tables.open_tables(spark, raw)
    assert {name: f.count() for name, f in frames.items()} == {"vm_metrics": 0, "app_events": 0, "topology": 0}
    assert frames["topology"].schema == schema.TOPOLOGY
    os.makedirs(f"{raw}/app_events")
    assert tables.read_chunks(spark, f"{raw}/app_events", "app_events").schema == schema.APP_EVENTS
    # union by name: a chunk with fewer columns and one with more
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    wide = pa.table({"ts": pa.array([dt.datetime(2026, 1, 1)], pa.timestamp("us")), "vm_id": ["x"], "heap_mb": [1.5]})
    pq.write_table(wide, f"{raw}/vm_metrics/wide.parquet")
    merged = tables.read_chunks(spark, f"{raw}/vm_metrics", "vm_metrics")
    assert merged.schema == schema.VM_METRICS
    assert sorted((r.vm_id, r.heap_mb) for r in merged.collect()) == [("vm-0", None), ("x", 1.5)]


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS obs_test LOCATION '{tmp_path}/db'")
    sinks.ensure_tables(spark, "obs_test")
    sinks.ensure_tables(spark, "obs_test")
    assert tables.read_catalog(spark, "obs_test", "vm_metrics").columns == [*schema.VM_METRICS.names, "ts_day"]
    m = fleet.metrics(spark, 4)
    m.withColumn("ts_day", F.to_date("ts")).write.insertInto("obs_test.vm_metrics")
    frames = tables.open_tables(spark, namespace="obs_test")
    assert frames["vm_metrics"].count() == m.count() == spark.table("vm_metrics").count()
    assert frames["topology"].count() == 0
    with pytest.raises(Exception):
        tables.read_catalog(spark, "obs_missing", "vm_metrics")
    assert tables.read_catalog(spark, "obs_missing", "topology", optional=True).count() == 0


def _rows_by_file(spark, lake):
    got = {os.path.basename(r._source_file): r["count"]
           for r in rows(spark, lake).groupBy("_source_file").count().collect()}
    ledger = {os.path.basename(r.file_path): r.rows for r in ingest.read_ledger(spark, lake).collect()}
    return got, ledger


def test_streams_and_hand_loads_share_no_batch(spark, dirs):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    ingest.ingest_stream(spark, raw, lake, "vm_metrics").awaitTermination()
    chunk(raw, "vm_metrics", "b.parquet", ["2026-01-01 08:10", "2026-01-02 08:00"])
    assert ingest.ingest_files(spark, raw, lake, "vm_metrics") == 1
    chunk(raw, "vm_metrics", "c.parquet", ["2026-01-01 08:20"])
    ingest.ingest_stream(spark, raw, lake, "vm_metrics").awaitTermination()
    chunk(raw, "vm_metrics", "d.parquet", ["2026-01-02 08:20"])
    chunk(raw, "vm_metrics", "e.parquet", [])
    added = sorted((os.path.basename(r.file_path), r.rows) for r in ingest.ingest_once(spark, raw, lake).collect())
    assert added == [("d.parquet", 1), ("e.parquet", 0)]
    got, ledger = _rows_by_file(spark, lake)
    assert got == {"a.parquet": 1, "b.parquet": 2, "c.parquet": 1, "d.parquet": 1}
    assert ledger == {**got, "e.parquet": 0}
    ids = [r.batch_id for r in ingest.read_ledger(spark, lake).select("batch_id").distinct().collect()]
    assert len(ids) == 5
    chunk(raw, "vm_metrics", "f.parquet", ["2026-01-03 08:20"])
    assert [os.path.basename(r.file_path) for r in ingest.ingest_once(spark, raw, lake).collect()] == ["f.parquet"]
    assert _rows_by_file(spark, lake)[1]["e.parquet"] == 0


@pytest.mark.parametrize("by_hand", [True, False])
def test_a_batch_that_broke_off_is_invisible_and_repeated(spark, dirs, monkeypatch, by_hand):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00", "2026-01-02 08:00"])
    written = ingest._replace

    def breaks(frame, path, *partitions):
        if path.endswith("ledger"):
            raise RuntimeError("lost")
        written(frame, path, *partitions)

    monkeypatch.setattr(ingest, "_replace", breaks)
    with pytest.raises(Exception, match="lost"):
        if by_hand:
            ingest.ingest_files(spark, raw, lake, "vm_metrics")
        else:
            ingest.ingest_stream(spark, raw, lake, "vm_metrics").awaitTermination()
    assert rows(spark, lake).count() == 0 and os.listdir(f"{lake}/_ingest/claims/vm_metrics") != []
    monkeypatch.setattr(ingest, "_replace", written)
    ingest.ingest_once(spark, raw, lake)
    assert rows(spark, lake).count() == 2
    assert [r.rows for r in ingest.read_ledger(spark, lake).collect()] == [2]


def test_chunks_with_different_columns(spark, dirs):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    wide = pa.table({"ts": pa.array([pd.Timestamp("2026-01-01 09:00")], pa.timestamp("us")), "heap_mb": pa.array([7.0], pa.float32()),
                     "vm_id": ["vm-1"], "other": [1]})
    pq.write_table(wide, os.path.join(raw, "vm_metrics", "dt=2026-01-01", "hour=08", "b.parquet"))
    want = [("vm-0", None), ("vm-1", 7.0)]
    read = tables.read_chunks(spark, f"{raw}/vm_metrics", "vm_metrics")
    assert sorted((r.vm_id, r.heap_mb) for r in read.collect()) == want
    ingest.ingest_stream(spark, raw, lake, "vm_metrics").awaitTermination()
    assert sorted((r.vm_id, r.heap_mb) for r in rows(spark, lake).collect()) == want
    ingest.ingest_files(spark, raw, f"{lake}2", "vm_metrics")
    assert sorted((r.vm_id, r.heap_mb) for r in rows(spark, f"{lake}2").collect()) == want


def test_a_table_without_a_folder_is_empty(spark, dirs):
    raw, lake = dirs
    chunk(raw, "vm_metrics", "a.parquet", ["2026-01-01 08:00"])
    assert ingest.ingest_files(spark, raw, lake, "app_events") == 0
    ingest.ingest_stream(spark, raw, lake, "app_events").awaitTermination()
    assert rows(spark, lake, "app_events").count() == 0
    assert ingest.ingest_once(spark, raw, lake).count() == 1
    chunk(raw, "app_events", "z.parquet", ["2026-01-01 08:00"])
    assert [r.table for r in ingest.ingest_once(spark, raw, lake).collect()] == ["app_events"]
