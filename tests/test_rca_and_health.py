import pytest
from pyspark.sql import functions as F

from fleetlens.config import Thresholds
from fleetlens.operators import health, questions, rca
from fleetlens.operators.features import app_latency
from fleetlens.operators.windows import instants
from fleetlens.plans import answers, sqlguard
from fleetlens.plans.detect import detect
from fleetlens.plans.lake import Lake
from fleetlens.schema import ALERTS, empty
from tests import fleet

CFG = Thresholds()
APPS = ["patient-onboarding", "ehr-api", "postgres-db"]


def leak(spark):
    """Two leaking VMs whose latency rises with the heap."""
    return fleet.metrics(spark, 240, {"patient-onboarding": 3, "postgres-db": 3}, [
        ("heap_mb", "patient-onboarding", 2, 5, 0, 22.0), ("app_latency_ms", "patient-onboarding", 2, 60, 0, 4.0),
        ("gc_pause_ms", "patient-onboarding", 2, 60, 0, 4.0)])


def text_of(spark, m, asof, app, cfg=CFG):
    found = rca.verdict(rca.facts(m, cfg, detect(m, cfg, asof), asof), cfg)
    return {r.app: r.text for r in rca.narrative(found).collect()}[app]


def test_narrative_names_the_leak(spark):
    text = text_of(spark, leak(spark), 30, "patient-onboarding")
    assert text.startswith("## patient-onboarding: root-cause summary (as of 01:29:30)\n\n- **Latency is elevated**: p95 ")
    assert "- **Worst VM patient-onboarding-000" in text
    assert "heap climbing +2" in text and "OOM ETA ~" in text
    assert "heap_leak" in text and "GC pauses ~" in text
    assert text.endswith("a rolling restart before the ETA.")


def test_narrative_of_a_healthy_app(spark):
    lines = text_of(spark, fleet.metrics(spark), 0, "postgres-db").split("\n")
    assert lines[2].startswith("- Latency p95 is ") and lines[2].endswith("near normal.")
    assert lines[3].endswith("— no single dominant metric.")
    assert lines[4:] == ["- No active alerts for this app."]


def test_narrative_of_io_saturation(spark):
    m = fleet.metrics(spark, incidents=[("disk_io_await_ms", "postgres-db", 3, 40, 0, 2.0),
                                        ("app_latency_ms", "postgres-db", 1, 40, 100, 0)])
    text = text_of(spark, m, 0, "postgres-db")
    assert "disk await ~" in text
    assert "**Likely cause:** downstream disk/IO saturation." in text
    assert "- **Active alerts**: 3x P2 — io_spike" in text or "apm_latency; io_spike" in text


def test_worst_vms_and_slowest_app(spark):
    m = leak(spark)
    found = rca.facts(m, CFG, empty(spark, ALERTS), 30).collect()
    worst = {r.app: [w.vm_id for w in r.worst] for r in found}["patient-onboarding"]
    assert len(worst) == 3 and set(worst[:2]) == {"patient-onboarding-0000", "patient-onboarding-0001"}
    assert rca.slowest_app(app_latency(m, CFG, instants(m, CFG))).first().app == "patient-onboarding"
    assert answers.default_app(m, CFG) == "patient-onboarding"


def test_alert_summary_order(spark):
    alerts = spark.createDataFrame([
        (None, s, r, v, "a", "", "", "") for s, r, v in [
            ("P2", "net_retrans", "1"), ("P2", "io_spike", "1"), ("P2", "io_spike", "2"), ("P1", "heap_leak", "3"),
            ("P2", "error_storm", "1"), ("P1", "error_storm", "2")]], ALERTS)
    row = rca.alert_summary(alerts).first()
    assert row.alert_counts == "4x P2, 2x P1"
    assert row.alert_rules == "error_storm; heap_leak; io_spike; net_retrans"
    assert row.leaking


def test_question_routing(spark):
    asked = ["what about EHR-API?", "is patient onboarding slow", "what is broken?",
             "ehr-api or patient-onboarding?", None]
    df = spark.createDataFrame([(q,) for q in asked], "question string")
    routed = questions.route(df, "kafka").collect()
    assert [r.app for r in routed] == ["ehr-api", "patient-onboarding", "kafka", "patient-onboarding", "kafka"]


@pytest.mark.parametrize("question, blast", [
    ("what happens if postgres-db goes down?", True), ("blast radius of ehr-api?", True),
    ("what is the impact if kafka fails?", True), ("why is patient onboarding slow?", False),
    ("did it FAIL?", True), ("failover plan", False)])
def test_intent(spark, question, blast):
    df = spark.createDataFrame([(question,)], "question string")
    assert df.select(questions.is_blast(F.col("question"))).first()[0] is blast


def test_answers_for_a_table_of_questions(spark):
    m = leak(spark)
    asked = spark.createDataFrame(
        [(1, "why is patient onboarding slow?"), (2, "what breaks if postgres-db goes down?"), (3, "what is broken?")],
        "id int, question string")
    got = answers.answer(asked, m, fleet.topology(spark), CFG, APPS, asof=30)
    text = {}
    for r in got.orderBy("id", "line_no", "line").collect():
        text.setdefault(r.id, []).append(r.line)
    assert text[1][0].startswith("## patient-onboarding: root-cause")
    assert text[2][0] == "## Blast radius: postgres-db"
    assert [x for x in text[2] if x.startswith("  depth")][0] == "  depth 1: ehr-api"
    assert any("patient-onboarding  ALERTS:" in x and "heap_leak" in x for x in text[2])
    assert text[3] == text[1]


def test_no_question_goes_without_an_answer(spark):
    """Also about apps without samples, and where no app has a latency at all."""
    asked = spark.createDataFrame([(1, "why is kafka slow?"), (2, "why is quiet-app slow?"), (3, "what if quiet-app fails?"),
                                   (4, None)], "id int, question string")
    m = leak(spark)
    got = answers.answer(asked, m, fleet.topology(spark), CFG, [*APPS, "quiet-app"], asof=30)
    text = {}
    for r in got.orderBy("id", "line_no", "line").collect():
        text.setdefault(r.id, []).append(r.line)
    assert set(text) == {1, 2, 3, 4} and all(line is not None for lines in text.values() for line in lines)
    assert text[2][0].startswith("## quiet-app: root-cause summary (as of ")
    assert text[2][2:] == ["- Latency p95 is 0 ms (baseline 0 ms) — near normal.", "- No active alerts for this app."]
    assert text[3][:3] == ["## Blast radius: quiet-app", "", "app: quiet-app"] and text[3][-2] == ""
    dark = m.withColumn("app_latency_ms", F.lit(None).cast("float"))
    assert {r.id for r in answers.answer(asked, dark, fleet.topology(spark), CFG, APPS, asof=30).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("sql", [
    "select reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT `java_method` ('java.lang.Math', 'random')",
    "select * from text.`/etc/hostname`", "WITH x AS (SELECT * FROM parquet.`/tmp`) SELECT * FROM x"])
def test_files_and_code_are_refused(spark, sql):
    with pytest.raises(sqlguard.ReadOnlySQLError):
        sqlguard.run(spark, sql)


def test_health_views(spark):
    m = fleet.metrics(spark, incidents=fleet.MIX)
    alerts = detect(m, CFG, 30)
    kpi = health.kpis(m, alerts).first()
    p1 = alerts.filter("severity = 'P1'").count()
    assert (kpi.n_vms, kpi.n_apps, kpi.n_samples) == (13, 4, 13 * 180)
    assert (kpi.n_p1, kpi.n_p2) == (p1, alerts.count() - p1)
    grid = {r.vm_id: r for r in health.grid(m, alerts).collect()}
    assert len(grid) == 13
    assert sorted(r.i for r in grid.values() if r.app == "patient-onboarding") == [0, 1, 2, 3]
    assert grid["billing-svc-0002"].status == "healthy"
    assert grid["postgres-db-0000"].status == "P2"
    assert health.default_vm(m, alerts).first()[0].startswith("patient-onboarding-000")
    quiet = fleet.metrics(spark)
    assert health.default_vm(quiet, detect(quiet, CFG)).first()[0] == "billing-svc-0000"
    silent = health.kpis(quiet, detect(quiet, CFG)).first()
    assert (silent.n_p1, silent.n_p2) == (0, 0)


def test_app_level_alerts_colour_no_vm(spark):
    alerts = spark.createDataFrame([(None, "P1", "apm_latency", "", "postgres-db", "", "", "")], ALERTS)
    statuses = {r.status for r in health.vm_status(fleet.metrics(spark, 4), alerts).collect()}
    assert statuses == {"healthy"}


def test_heap_series_phases(spark):
    m = fleet.metrics(spark)
    rows = health.heap_series(m, CFG, "kafka-none", 30).collect()
    assert rows == []
    rows = health.heap_series(m, CFG, "postgres-db-0001", 30).collect()
    assert len(rows) == 180 and [r.ts for r in rows] == sorted(r.ts for r in rows)
    assert [r.phase for r in rows].count("after-now") == 60
    assert {r.heap_cap_mb for r in rows} == {4096.0}


@pytest.mark.parametrize("sql", [
    "DROP TABLE vm_metrics", "INSERT INTO x VALUES (1)", "UPDATE x SET a = 1", "SELECT 1; DROP TABLE x",
    "PRAGMA x", "COPY x TO 'y'", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "SELECT 'set' AS x", ""])
def test_guard_refuses(spark, sql):
    with pytest.raises(sqlguard.ReadOnlySQLError):
        sqlguard.run(spark, sql)


def test_guard_accepts_and_caps(spark):
    spark.range(120).createOrReplaceTempView("numbers")
    one = sqlguard.run(spark, "  select count(*) AS n FROM numbers ; ")
    assert one.rows.first().n == 120 and one.text().startswith("rows: 1\n")
    many = sqlguard.run(spark, "WITH x AS (SELECT id FROM numbers) SELECT id FROM x ORDER BY id")
    assert many.rows.count() == 120
    assert many.text().endswith("... (120 rows, showing 50)")


def test_lake_handle(spark):
    lake = Lake(leak(spark), fleet.topology(spark), CFG, APPS)
    lake.metrics.createOrReplaceTempView("vm_metrics")
    assert lake.call("run_sql", sql="SELECT count(*) AS n FROM vm_metrics").rows.first().n == 6 * 240
    assert "heap_leak" in {r.rule for r in lake.call("get_alerts", severity="p1", asof=30.0).collect()}
    assert lake.call("run_sql", sql="SELECT count(*) AS n FROM alerts").rows.first().n > 0
    trace = lake.call("trace_dependencies", app="postgres-db", asof=30.0)
    assert [r.app for r in trace.collect()][0] == "ehr-api"
    answer = [r.line for r in lake.answer("why is patient onboarding slow?", 30.0).collect()]
    assert answer[0].startswith("## patient-onboarding")
    assert lake.call("run_sql", sql="DROP TABLE x").startswith("ERROR: ReadOnlySQLError")
    assert lake.call("nothing") == "unknown tool: nothing"


def test_open_lake(spark, tmp_path):
    from fleetlens.sources import sinks
    sinks.write_chunks(fleet.metrics(spark, 4), str(tmp_path), "vm_metrics")
    lake = Lake.open(spark, str(tmp_path))
    assert lake.metrics.count() == 13 * 4 and lake.topology.count() == 0
