import json

from pyspark.sql import functions as F

from fleetlens import schema
from fleetlens.config import Thresholds
from fleetlens.operators import quality
from fleetlens.plans.detect import detect, hits
from fleetlens.sources import sinks, tables
from tests import fleet

CFG = Thresholds()


def test_chunk_layout(spark, tmp_path):
    m = fleet.metrics(spark)
    path = sinks.write_chunks(m, str(tmp_path), "vm_metrics")
    back = spark.read.parquet(path)
    assert {(str(r.dt), r.hour) for r in back.select("dt", "hour").distinct().collect()} == {("2026-01-01", 0), ("2026-01-01", 1)}
    got = tables.read_chunks(spark, path, "vm_metrics")
    assert got.schema == schema.VM_METRICS
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, m.collect()))
    listed = tables.list_chunks(spark, str(tmp_path)).collect()
    assert {r.table for r in listed} == {"vm_metrics"} and all(r.length > 0 for r in listed)


def test_fixed_slices(spark, tmp_path):
    m = fleet.metrics(spark)
    path = sinks.rechunk(m, str(tmp_path), "vm_metrics", fleet.START_US, 20)
    counts = {r.chunk: r["count"] for r in spark.read.parquet(path).groupBy("chunk").count().collect()}
    assert counts == {0: 520, 1: 520, 2: 520, 3: 520, 4: 260}


def test_dimension_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "topology")
    assert sinks.write_dimension(fleet.topology(spark), path) == 8
    assert sinks.write_dimension(fleet.topology(spark, per_app=1), path) == 4
    assert tables.read_chunks(spark, path, "topology").count() == 4


def test_alert_sinks(spark, tmp_path):
    alerts = detect(fleet.metrics(spark, incidents=fleet.MIX), CFG, 30)
    n = alerts.count()
    sinks.write_alerts_json(alerts, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json")).collect()
    assert len(back) == n and {r.ts for r in back} == {"2026-01-01 00:59:30"}
    assert all(json.loads(r.evidence_json) for r in back)

    path = str(tmp_path / "table")
    sinks.append_alerts(alerts, path)
    sinks.append_alerts(alerts.limit(0), path)
    assert sinks.read_alerts(spark, path).count() == n
    sinks.append_alerts(alerts, path)
    assert sinks.read_alerts(spark, path).count() == 2 * n
    sinks.append_alerts(alerts, path, replace_instant=True)
    assert sinks.read_alerts(spark, path).count() == n
    other = detect(fleet.metrics(spark, incidents=fleet.MIX), CFG, 20)
    sinks.append_alerts(other, path, replace_instant=True)
    assert sinks.read_alerts(spark, path).count() == n + other.count()


def test_a_replaced_instant_may_lose_all_its_alerts(spark, tmp_path):
    alerts = detect(fleet.metrics(spark, incidents=fleet.MIX), CFG, 30)
    instant = alerts.first().ts
    path = str(tmp_path / "table")
    sinks.append_alerts(alerts, path, replace_instant=True, instant=instant)
    other = detect(fleet.metrics(spark, incidents=fleet.MIX), CFG, 20)
    sinks.append_alerts(other, path, replace_instant=True)
    sinks.append_alerts(alerts.limit(0), path, replace_instant=True, instant=instant)
    assert sinks.read_alerts(spark, path).count() == other.count()
    sinks.append_alerts(alerts, path, replace_instant=True, instant=instant)
    assert sinks.read_alerts(spark, path).count() == other.count() + alerts.count()


def test_digest(spark):
    alerts = detect(fleet.metrics(spark, incidents=fleet.MIX), CFG, 30)
    lines = [f"[{r.severity}] {r.rule} — {r.headline}" for r in alerts.collect()]
    one, = sinks.digest(alerts, 30).collect()
    assert one.headline == f":rotating_light: {len(lines)} alert(s) (asof -30m)"
    assert one.text.split("\n") == lines
    payload = json.loads(one.payload)
    assert payload == {"text": one.headline, "attachments": [{"color": "#d00000", "text": one.text}]}
    pages = sinks.digest(alerts, 30, page_size=2).orderBy("page").collect()
    assert [x for p in pages for x in p.text.split("\n")] == lines
    quiet, = sinks.digest(alerts.limit(0), 15).collect()
    assert (quiet.n_alerts, quiet.color, quiet.text) == (0, "#2eb886", "")
    assert quiet.headline == ":white_check_mark: No alerts (asof -15m)."


def test_clip(spark):
    m = fleet.rows(spark, [{"minute": 0, "heap_mb": -1}, {"minute": 1, "heap_mb": 2}, {"minute": 2, "heap_mb": None}])
    assert [r.heap_mb for r in quality.clip_metrics(m).orderBy("ts").collect()] == [0.0, 2.0, None]


def test_downsample(spark):
    vms = fleet.vms(spark, {"big": 800, "mid": 180, "tiny": 20}).select("vm_id", "app", "site")
    kept = quality.downsample_fleet(vms, 100)
    sizes = {r.app: r["count"] for r in kept.groupBy("app").count().collect()}
    assert sizes == {"big": 80, "mid": 18, "tiny": 2}
    assert {r.vm_id for r in kept.filter("app = 'tiny'").collect()} == {"tiny-0000", "tiny-0001"}
    few = {r.app: r["count"] for r in quality.downsample_fleet(vms, 5).groupBy("app").count().collect()}
    assert few == {"big": 4, "mid": 1, "tiny": 1}
    assert quality.downsample_fleet(vms, 1000).count() == 1000


def test_target_selection(spark):
    vms = fleet.vms(spark)
    assert [r.vm_id for r in quality.select_vms(vms, "patient-onboarding", count=2).collect()] == [
        "patient-onboarding-0000", "patient-onboarding-0001"]
    assert [r.vm_id for r in quality.select_vms(vms, "patient-onboarding", site="dc-west", count=1).collect()] == [
        "patient-onboarding-0001"]
    assert quality.select_vms(vms, vms=["postgres-db-0002", "none"]).count() == 1
    assert quality.first_vms(vms, 1).count() == 8


def test_incident_labels_are_half_open(spark):
    m = fleet.rows(spark, [{"minute": x} for x in range(0, 10)])
    incidents = spark.createDataFrame([("slow", "vm-0", 2, 5), ("other", "vm-9", 0, 9)], "incident string, vm_id string, a int, b int")
    at = lambda name: F.timestamp_micros(F.lit(fleet.START_US) + F.col(name) * fleet.MINUTE)
    found = quality.label_incidents(m, incidents.select("incident", "vm_id", at("a").alias("start_ts"), at("b").alias("end_ts")))
    assert [r.elapsed_min for r in found.orderBy("ts").collect()] == [0.0, 1.0, 2.0]


def test_crossings_leads_and_scores(spark):
    m = fleet.metrics(spark, 240, incidents=[("heap_mb", "patient-onboarding", 2, 5, 0, 40.0)])
    crossed = quality.first_crossings(m, CFG.heap_cap_mb)
    assert crossed.schema.names == schema.APP_EVENTS.names
    events = crossed.collect()
    assert {r.vm_id for r in events} == {"patient-onboarding-0000", "patient-onboarding-0001"}
    assert {r.event_type for r in events} == {"oom_kill"}
    assert events[0].message == "java.lang.OutOfMemoryError: Java heap space (cap 4096MB)"
    timeline = hits(m, CFG, "heap_leak", [100.0, 90.0, 80.0])
    leads = quality.lead_times(timeline, crossed).collect()
    assert len(leads) == 2 and all(r.lead_min > 0 for r in leads)
    truth = m.filter("app = 'patient-onboarding'").select(F.lit("heap_leak").alias("rule"), "vm_id")
    row, = quality.score(timeline.select("rule", "vm_id"), truth).collect()
    assert (row.tp, row.fp, row.fn) == (2, 0, 2)


def test_thinning(spark):
    m = fleet.metrics(spark, 100)
    kept = quality.thin(m, 10, "minute")
    per_vm = {r.vm_id: r["count"] for r in kept.groupBy("vm_id").count().collect()}
    assert set(per_vm.values()) == {10} and len(per_vm) == 13
    first = kept.filter("vm_id = 'postgres-db-0001'").orderBy("ts").select(F.unix_micros("ts")).collect()
    assert [(r[0] - fleet.START_US) // 1_000_000 for r in first] == [i * 300 for i in range(10)]


def test_slice_follows_the_busiest_vm(spark):
    m = fleet.metrics(spark, 180)
    assert quality.time_slice(m) == "day"
    # 180 samples in 90 minutes: 120 in an hour, 2 in a minute, 1 in a second
    assert quality.time_slice(m, 150) == "hour"
    assert quality.time_slice(m, 10) == "minute"
    assert quality.time_slice(m, 1) == "second"
    by_day, by_minute = (sorted(map(tuple, quality.thin(m, 7, unit).collect())) for unit in ("day", "minute"))
    assert by_day == by_minute


def test_healthy_metrics_stay_in_their_band(spark):
    m = fleet.metrics(spark, noise=0.05)
    audit = quality.band_audit(m, quality.app_means(m), 0.05).collect()
    assert len(audit) == 4 * 9 and sum(r.n_outside for r in audit) == 0
    sick = fleet.metrics(spark, incidents=fleet.MIX)
    outside = {(r.app, r.metric) for r in quality.band_audit(sick, quality.app_means(m), 0.05).collect() if r.n_outside}
    assert outside == {("patient-onboarding", "heap_mb"), ("postgres-db", "disk_io_await_ms"),
                       ("hl7-ingest", "net_retrans_pct"), ("billing-svc", "error_rate_pct")}
