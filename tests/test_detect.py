import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetlens.config import Thresholds
from fleetlens.operators.features import vm_features
from fleetlens.operators.rules import RULES, Rule
from fleetlens.operators.windows import instants, tag_instants
from fleetlens.plans import detect
from fleetlens.schema import ALERTS, VM_METRICS, empty
from tests import fleet

CFG = Thresholds()


def by_rule(alerts):
    out = {}
    for row in alerts.collect():
        out.setdefault(row.rule, []).append(row)
    return out


def test_incident_mix_fires_on_the_injected_vms(spark):
    m = fleet.metrics(spark, incidents=fleet.MIX)
    found = by_rule(detect.detect(m, CFG, asof=30))
    assert {"heap_leak", "io_spike", "net_retrans", "error_storm"} <= set(found)
    assert {r.vm_id for r in found["heap_leak"]} == {"patient-onboarding-0000", "patient-onboarding-0001"}
    assert {r.vm_id for r in found["io_spike"]} == {"postgres-db-0000"}
    assert {r.vm_id for r in found["net_retrans"]} == {"hl7-ingest-0000"}
    assert {r.vm_id for r in found["error_storm"]} == {"billing-svc-0000"}
    for row in found["heap_leak"]:
        evidence = json.loads(row.evidence_json)
        assert list(evidence) == sorted(evidence)
        assert 0 < evidence["oom_eta_min"] < 120
        assert abs(evidence["slope_mb_min"] - 25) < 5
        assert evidence["heap_cap_mb"] == 4096.0
        assert row.headline.startswith(f"Heap leak on {row.vm_id}: +")


@pytest.mark.parametrize("asof", [0, 30, 60])
def test_healthy_fleet_is_silent(spark, asof):
    assert detect.detect(fleet.metrics(spark), CFG, asof=asof).count() == 0


def test_eta_falls_over_the_replay(spark):
    m = fleet.metrics(spark, 240, incidents=[("heap_mb", "patient-onboarding", 1, 5, 0, 20.0)])
    timeline = {r.asof: r for r in detect.eta_timeline(m, CFG).collect()}
    assert timeline[45].oom_eta_min > timeline[30].oom_eta_min > timeline[15].oom_eta_min
    assert timeline[45].eta_change is None and timeline[30].eta_change < 0


def test_replay_equals_single_runs(spark):
    m = fleet.metrics(spark, incidents=fleet.MIX)
    together = detect.replay(m, CFG, [30.0, 0.0])
    for asof in (30.0, 0.0):
        single = detect.detect(m, CFG, asof=asof)
        part = together.filter(F.col("asof") == asof).select(*ALERTS.names)
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, single.collect()))


def test_contract_and_order(spark):
    m = fleet.metrics(spark, incidents=fleet.MIX)
    alerts = detect.detect(m, CFG, asof=30)
    assert alerts.columns == ALERTS.names
    rows = alerts.collect()
    assert [(r.severity, r.rule, r.vm_id) for r in rows] == sorted((r.severity, r.rule, r.vm_id) for r in rows)
    assert len({r.ts for r in rows}) == 1
    silent = detect.detect(fleet.metrics(spark), CFG)
    assert silent.columns == ALERTS.names


def test_empty_fact_is_an_error(spark):
    with pytest.raises(ValueError, match="empty"):
        detect.detect(empty(spark, VM_METRICS), CFG)


def test_window_edges(spark):
    # data 0..120 min; recent (110, 120], heap (90, 120], baseline [0, 30)
    minutes = [0, 29.999, 30, 90, 90.001, 110, 110.001, 120]
    m = fleet.rows(spark, [{"minute": x, "heap_mb": 1} for x in minutes])
    points = instants(m, CFG)
    flags = {round((r.us - fleet.START_US) / fleet.MINUTE, 3): (r.in_recent, r.in_heap, r.in_base)
             for r in tag_instants(m, points).select(
                 F.unix_micros("ts").alias("us"), "in_recent", "in_heap", "in_base").collect()}
    no, yes = False, True
    assert flags == {
        0.0: (no, no, yes), 29.999: (no, no, yes), 90.001: (no, yes, no),
        110.0: (no, yes, no), 110.001: (yes, yes, no), 120.0: (yes, yes, no)}


def test_baseline_shrinks_and_vanishes_for_early_instants(spark):
    m = fleet.rows(spark, [{"minute": x, "error_rate_pct": 50, "net_retrans_pct": 9} for x in range(0, 61)])
    late, early, none = instants(m, CFG, [0.0, 35.0, 55.0])
    assert (late.base_hi - late.start) // fleet.MINUTE == 30
    assert (early.base_hi - early.start) // fleet.MINUTE == 15
    assert none.base_hi < none.start
    # no baseline: the comparing rules are silent, the others still work
    assert {r.rule for r in detect.detect(m, CFG, asof=55.0).collect()} == {"net_retrans"}


def test_threshold_is_strict(spark):
    for value, expected in ((5.0, 0), (5.125, 1)):
        m = fleet.rows(spark, [{"minute": x, "net_retrans_pct": value} for x in range(0, 60)])
        assert detect.detect(m, CFG).count() == expected


def _ramp(spark, n, **extra):
    # n samples inside the trailing window, rising 50 MB/min towards 4096
    return fleet.rows(spark, [{"minute": 0, "heap_mb": 100}] + [
        {"minute": 120 - i, "heap_mb": 3900 - 50 * i, **extra} for i in range(n)])


def test_heap_leak_needs_eight_samples(spark):
    assert detect.detect(_ramp(spark, 7), CFG).count() == 0
    assert [r.severity for r in detect.detect(_ramp(spark, 8), CFG).collect()] == ["P1"]


def test_heap_above_the_cap_is_a_p1_with_negative_eta(spark):
    m = fleet.rows(spark, [{"minute": 0}] + [{"minute": 120 - i, "heap_mb": 4500 - 50 * i} for i in range(12)])
    row = detect.detect(m, CFG).first()
    assert row.severity == "P1"
    assert json.loads(row.evidence_json)["oom_eta_min"] < 0


def test_latest_heap_skips_nulls(spark):
    m = _ramp(spark, 10).unionByName(fleet.rows(spark, [{"minute": 120.5, "heap_mb": None}]))
    features = vm_features(m, CFG, instants(m, CFG)).first()
    assert features.heap_now == 3900
    assert features.n_heap == 11


def test_constant_metric_is_safe(spark):
    m = fleet.rows(spark, [{"minute": x, "heap_mb": 3000, "disk_io_await_ms": 5} for x in range(0, 121)])
    features = vm_features(m, CFG, instants(m, CFG)).first()
    assert features.heap_corr is None
    assert features.heap_slope == 0
    assert detect.detect(m, CFG).count() == 0


def test_app_latency_fires_and_survives_a_zero_baseline(spark):
    def app(name, before, now):
        return [{"minute": x, "app": name, "vm_id": f"{name}-0000",
                 "app_latency_ms": before if x < 60 else now} for x in range(0, 121)]

    m = fleet.rows(spark, app("slow", 50, 200) + app("zero", 0, 90) + app("tiny", 1, 50) + app("same", 100, 190))
    found = {r.app: r for r in detect.detect(m, CFG).collect()}
    assert set(found) == {"slow", "zero"}
    assert found["slow"].vm_id == "" and found["slow"].severity == "P2"
    assert json.loads(found["slow"].evidence_json) == {"baseline_p95_ms": 50.0, "factor_x": 4.0, "p95_ms": 200.0}
    assert found["slow"].headline == "Latency regression on slow: p95 200ms (>2x baseline 50ms)"
    assert "factor_x" not in json.loads(found["zero"].evidence_json)


def test_vm_that_changed_its_app_keeps_its_baseline(spark):
    m = fleet.rows(spark, [
        {"minute": x, "app": "old" if x < 60 else "new", "error_rate_pct": 1 if x < 60 else 20}
        for x in range(0, 121)])
    row = detect.detect(m, CFG).first()
    assert (row.rule, row.app, row.severity) == ("error_storm", "new", "P1")
    assert row.headline == "Error storm on vm-0: 20.0% errors (20x baseline)"


def test_missing_ids_become_empty_text(spark):
    m = fleet.rows(spark, [
        {"minute": x, "vm_id": None, "app": None, "net_retrans_pct": 9, "error_rate_pct": 90} for x in range(0, 121)])
    row, = detect.detect(m, CFG).collect()
    # compared with nothing, so only the plain threshold rule sees it
    assert (row.rule, row.vm_id, row.app) == ("net_retrans", "", "")


def test_given_fleet_replaces_the_lookup(spark):
    m = fleet.metrics(spark, incidents=fleet.MIX)
    known = m.select("vm_id", "app").distinct()
    assert (sorted(map(tuple, detect.detect(m, CFG, 30, fleet=known).collect()))
            == sorted(map(tuple, detect.detect(m, CFG, 30).collect())))


def test_own_rule(spark):
    busy = Rule(
        name="busy_io", scope="vm", app="app_recent", fires=lambda c: F.col("io_recent") > 1,
        severity=lambda c: F.lit("P3"), evidence=lambda c: {"await_ms": F.col("io_recent")}, digits={"await_ms": 1},
        headline=lambda c: F.concat(F.lit("busy "), F.col("vm_id")), action="look")
    m = fleet.metrics(spark)
    found = by_rule(detect.detect(m, CFG, rules={**RULES, "busy_io": busy}))
    assert list(found) == ["busy_io"] and len(found["busy_io"]) == 13


def test_alert_filter(spark):
    alerts = detect.detect(fleet.metrics(spark, incidents=fleet.MIX), CFG, asof=30)
    p2 = detect.select_alerts(alerts, severity="p2")
    assert {r.severity for r in p2.collect()} == {"P2"}
    assert p2.columns == ["severity", "rule", "vm_id", "app", "headline"]
    assert {r.app for r in detect.select_alerts(alerts, app="billing-svc").collect()} == {"billing-svc"}
    assert detect.select_alerts(alerts, app="nobody").count() == 0


def test_text_rounds_ties_to_even(spark):
    m = fleet.rows(spark, [{"minute": x, "net_retrans_pct": 6.25} for x in range(0, 60)])
    row = detect.detect(m, replace(CFG, retrans_pct=4.5)).first()
    assert row.headline == "Network retransmits on vm-0: 6.2% (> 4%)"
    assert json.loads(row.evidence_json) == {"retrans_pct": 6.25, "threshold_pct": 4.5}


def test_config_from_settings():
    cfg = Thresholds.from_settings({"heap_limit_mb": "2048", "latency_x": "3"})
    assert (cfg.heap_cap_mb, cfg.latency_x, cfg.io_z, cfg.retrans_pct) == (2048, 3, 4, 5)
