"""Every query of the package on the driver tables, by name.

Time stamps are returned as epoch microseconds and statistics rounded to six
decimals, so that results can be compared across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetlens import driver_tables as dt, schema
from fleetlens.operators import graph, health, history, quality, questions, rca, rules, sketches, versions, windows
from fleetlens.operators.features import app_latency, frames, vm_features
from fleetlens.plans import answers, detect, sqlguard
from fleetlens.session import checkpoint, prepare, scratch_dir
from fleetlens.sources import sinks, tables
from fleetlens.streaming import ingest, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CFG = dt.CONFIG
col = F.col

# Questions in the driver tables are prose; these words do occur in it.
WORDS = ["que-la", "une", "the"]
HINTS = ["the ", "que"]
CHUNK_MINUTES = 3 * 1440.0
LIVE_SLIDE_S = 5 * 21_600
LIVE_DELAY = "1 minute"
# Instants of three topology loads.
LOADED = [datetime(2024, 1, day, tzinfo=timezone.utc) for day in (1, 5, 9)]


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepare(spark), sf_dir)

    QUERIES[run.__name__] = prepared
    return run


def r6(df: DataFrame) -> DataFrame:
    """Round every double to six decimals and widen ints."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(F.round(col(name).cast("double"), 6).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(col(name).cast("long").alias(name))
        else:
            out.append(col(name))
    return df.select(out)


def us(name: str) -> Column:
    return F.unix_micros(name).alias(f"{name}_us")


def _alerts(m: DataFrame) -> DataFrame:
    """Alerts as of the data end, for queries that build on them."""
    return detect.detect(m, CFG, ordered=False)


# --- windows and features ---------------------------------------------------

@query
def evaluation_windows(spark, sf):
    """Data bounds and the windows of each replay instant."""
    points = windows.instants(dt.vm_metrics(spark, sf), CFG, dt.REPLAY)
    return spark.createDataFrame(
        [(p.asof, p.start, p.end, p.recent_lo, p.heap_lo, p.base_hi) for p in points],
        "asof double, start_us long, end_us long, recent_lo_us long, heap_lo_us long, base_hi_us long")


@query
def window_samples(spark, sf):
    """Samples per instant, app and window."""
    m = dt.vm_metrics(spark, sf)
    points = windows.instants(m, CFG, dt.REPLAY)
    tagged = windows.tag_instants(m, points)
    counted = tagged.groupBy(*windows.slot_keys(points), "app").agg(
        F.count_if("in_recent").alias("n_recent"), F.count_if("in_heap").alias("n_heap"),
        F.count_if("in_base").alias("n_base"))
    return windows.spread_slots(counted, points, ["app"]).drop("t_end")


@query
def vm_window_features(spark, sf):
    """The feature frame of every VM at every replay instant."""
    m = dt.vm_metrics(spark, sf)
    return r6(vm_features(m, CFG, windows.instants(m, CFG, dt.REPLAY)).select(
        "asof", "vm_id", "app", "n_heap", "heap_slope", "heap_corr", "heap_now", "n_recent", "io_recent",
        "iops_now", "retrans_recent", "err_recent", "gc_recent", "latency_recent", "heap_slope_recent",
        "n_base", "io_base", "io_base_std", "err_base"))


@query
def app_latency_p95_distributed(spark, sf):
    """The percentiles of each instant on its own."""
    m = dt.vm_metrics(spark, sf)
    found = None
    for point in windows.instants(m, CFG, dt.REPLAY):
        one = app_latency(m, CFG, [point])
        found = one if found is None else found.unionByName(one)
    return r6(found.select("asof", "app", "p95_recent", "p95_base"))


@query
def app_latency_p95(spark, sf):
    """Exact p95 latency of every app at every replay instant."""
    m = dt.vm_metrics(spark, sf)
    return r6(app_latency(m, CFG, windows.instants(m, CFG, dt.REPLAY)).select(
        "asof", "app", "p95_recent", "p95_base"))


# --- detection --------------------------------------------------------------

def _hits(spark, sf, rule):
    return r6(detect.hits(dt.vm_metrics(spark, sf), CFG, rule).drop("asof", "t_end"))


@query
def heap_leak(spark, sf):
    """D1"""
    return _hits(spark, sf, "heap_leak")


@query
def io_spike(spark, sf):
    """D2"""
    return _hits(spark, sf, "io_spike")


@query
def net_retrans(spark, sf):
    """D3"""
    return _hits(spark, sf, "net_retrans")


@query
def apm_latency(spark, sf):
    """D4"""
    return _hits(spark, sf, "apm_latency")


@query
def error_storm(spark, sf):
    """D5"""
    return _hits(spark, sf, "error_storm")


@query
def detect_alerts(spark, sf):
    """All alerts as of the data end, with their text."""
    return detect.detect(dt.vm_metrics(spark, sf), CFG).select(
        us("ts"), "severity", "rule", "vm_id", "app", "headline", "action")


@query
def alerts_without_ids(spark, sf):
    """Samples of one app that have lost their VM id: alerts show an empty one."""
    m = dt.vm_metrics(spark, sf)
    lost = m.withColumn("vm_id", F.when(col("app") != "app-3", col("vm_id")))
    return detect.detect(lost, replace(CFG, retrans_pct=1.0)).filter("rule = 'net_retrans' AND vm_id = ''").select(
        us("ts"), "severity", "rule", "vm_id", "app", "headline", "action")


@query
def empty_tables_union(spark, sf):
    """A typed empty table put beside the fact by name changes neither rows nor types."""
    m = dt.vm_metrics(spark, sf).unionByName(schema.empty(spark, schema.VM_METRICS)).unionByName(
        tables.read_chunks(spark, scratch_dir(spark, "nothing"), "vm_metrics"))
    return r6(m.groupBy("app").agg(F.count("*").alias("n"), F.sum(col("heap_mb").cast("double")).alias("heap")))


@query
def alert_evidence(spark, sf):
    """The evidence JSON, read back key by key with its rounded values."""
    found = _alerts(dt.vm_metrics(spark, sf))
    evidence = F.from_json("evidence_json", "map<string,double>")
    return found.select("rule", "vm_id", "app", F.explode(evidence).alias("evidence_key", "x"))


@query
def replay_alerts(spark, sf):
    """Alerts of four instants from one job."""
    return detect.replay(dt.vm_metrics(spark, sf), CFG, dt.REPLAY).select(
        "asof", us("ts"), "severity", "rule", "vm_id", "app")


@query
def replay_rule_counts(spark, sf):
    """Alerts per instant, rule and severity."""
    return detect.rule_counts(detect.replay(dt.vm_metrics(spark, sf), CFG, dt.REPLAY))


@query
def replay_eta_timeline(spark, sf):
    """How the time to exhaustion moves over the replay."""
    return r6(detect.eta_timeline(dt.vm_metrics(spark, sf), CFG, dt.REPLAY).drop("t_end"))


@query
def alerts_by_severity_and_app(spark, sf):
    """D9"""
    return detect.select_alerts(_alerts(dt.vm_metrics(spark, sf)), "p1", "app-3")


@query
def alert_summary_by_app(spark, sf):
    """Severity counts and rules of each app."""
    return rca.alert_summary(_alerts(dt.vm_metrics(spark, sf)))


# --- graph ------------------------------------------------------------------

def _nation_edges(spark, sf):
    return graph.edges(graph.build_topology(dt.fleet(spark, sf), dt.edge_list(spark, sf)))


@query
def topology_rows(spark, sf):
    """One row per VM and dependency."""
    return graph.build_topology(dt.fleet(spark, sf), dt.edge_list(spark, sf))


@query
def dependency_edges(spark, sf):
    """G1, P6, A14"""
    return _nation_edges(spark, sf)


@query
def downstream_apps(spark, sf):
    """Impacted apps of the given ones, at least depth."""
    e = _nation_edges(spark, sf)
    return r6(graph.reach(e, graph.roots_of(spark, "NATION_0", "NATION_3"), graph.DOWNSTREAM))


@query
def ordered_downstream(spark, sf):
    """K5: impacted apps in the order in which they are shown, by depth and name."""
    e = _nation_edges(spark, sf)
    found = graph.reach(e, graph.roots_of(spark, "NATION_0", "NATION_3"), graph.DOWNSTREAM)
    return r6(found.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("depth", "app"))))


def _cyclic_edges(spark, sf):
    """The nation tree, whose root depends on one of its leaves."""
    return _nation_edges(spark, sf).unionByName(
        spark.createDataFrame([("NATION_0", "NATION_20")], "app string, depends_on_app string"))


@query
def cyclic_reach(spark, sf):
    """Impacted apps where dependencies go round."""
    return r6(graph.reach(_cyclic_edges(spark, sf), graph.roots_of(spark, "NATION_2", "NATION_20")))


@query
def cyclic_hops(spark, sf):
    """Path lengths where dependencies go round; no path uses an edge twice."""
    return r6(graph.hops(_cyclic_edges(spark, sf), graph.roots_of(spark, "NATION_2", "NATION_20")))


@query
def target_vms(spark, sf):
    """R2: the first VMs of an app, and VMs by name."""
    fleet = dt.fleet(spark, sf)
    return (quality.select_vms(fleet, app="NATION_3", count=3)
            .unionByName(quality.select_vms(fleet, vms=["Supplier#000000001", "Supplier#000000002"])))


@query
def upstream_apps(spark, sf):
    """Needed apps of the given ones, at least depth."""
    e = _nation_edges(spark, sf)
    return r6(graph.reach(e, graph.roots_of(spark, "NATION_20", "NATION_24"), graph.UPSTREAM))


@query
def blast_radius_hops(spark, sf):
    """Impacted apps within five hops."""
    e = _nation_edges(spark, sf)
    return r6(graph.hops(e, graph.roots_of(spark, "NATION_0", "NATION_2"), graph.DOWNSTREAM, 5))


@query
def dependency_chain_hops(spark, sf):
    """Needed apps within five hops."""
    e = _nation_edges(spark, sf)
    return r6(graph.hops(e, graph.roots_of(spark, "NATION_20", "NATION_24"), graph.UPSTREAM, 5))


@query
def fault_to_symptom_paths(spark, sf):
    """G7"""
    found = graph.paths(_nation_edges(spark, sf), "NATION_0", "NATION_20")
    return r6(found.withColumn("path", F.array_join("path", " > ")))


@query
def vms_in_blast_radius(spark, sf):
    """G8"""
    e = _nation_edges(spark, sf)
    return graph.vms_in_radius(e, graph.roots_of(spark, "NATION_1"), dt.fleet(spark, sf), 5)


@query
def dependency_trace(spark, sf):
    """Both directions of every app, with active alerts."""
    m = dt.vm_metrics(spark, sf)
    t = dt.app_topology(spark, sf)
    return r6(graph.trace(t, None, _alerts(m)))


@query
def all_pairs_reach(spark, sf):
    """Who is hit by whom, for all apps of a graph that goes round, in rounds of doubling."""
    return r6(graph.all_pairs(_cyclic_edges(spark, sf)))


@query
def fault_to_symptom_counts(spark, sf):
    """How many paths of each length lead from a fault to a symptom, through a ladder of nations; none is listed."""
    n = dt.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    step = n.select("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("by")).filter("k + by <= 24")
    name = [F.concat(F.lit("N"), (col("k") + by).cast("string")) for by in (col("by"), F.lit(0))]
    found = graph.path_counts(step.select(name[0].alias("app"), name[1].alias("depends_on_app")), "N0", "N24", 24)
    return found.select(col("hops").cast("long").alias("hops"), col("n_paths").cast("long").alias("n_paths"))


def _topology_loads(spark, sf):
    """Three loads of the topology: all nations, those with an even key and the first ten, and all but the last five."""
    key = F.regexp_extract("app", r"(\d+)$", 1).cast("int")
    full = _nation_edges(spark, sf)
    loads = [full, full.filter((key % 2 == 0) | (key < 10)), full.filter(key < 20)]
    found = versions.first_versions(loads[0], LOADED[0])
    for rows, at in zip(loads[1:], LOADED[1:], strict=True):
        found = checkpoint(versions.merged(found, rows, at))
    return found


@query
def topology_changes(spark, sf):
    """What each load of the topology opened and closed."""
    return versions.changes(_topology_loads(spark, sf)).select(us("at"), "opened", "closed")


@query
def trace_as_of_load(spark, sf):
    """Who is hit, in the topology as it was at an earlier load."""
    then = versions.as_of(_topology_loads(spark, sf), LOADED[1])
    return r6(graph.reach(then, graph.roots_of(spark, "NATION_0", "NATION_3")))


# --- root cause and questions -----------------------------------------------

@query
def slowest_app(spark, sf):
    """K1, as of every replay instant's newest: the data end."""
    m = dt.vm_metrics(spark, sf)
    return r6(rca.slowest_app(app_latency(m, CFG, windows.instants(m, CFG))))


@query
def worst_vms_by_app(spark, sf):
    """Q2, K2"""
    m = dt.vm_metrics(spark, sf)
    return r6(rca.worst_vms(vm_features(m, CFG, windows.instants(m, CFG)), CFG))


def _facts(spark, sf):
    """Facts and alerts as of the data end, from one aggregation of the fact."""
    m = dt.vm_metrics(spark, sf)
    found = frames(m, CFG, windows.instants(m, CFG)).kept()
    alerts = detect.alerts_of(found, CFG).drop("asof")
    return rca.facts(m, CFG, alerts, found=found), alerts


def _judged(spark, sf):
    return rca.verdict(_facts(spark, sf)[0], CFG)


@query
def rca_facts(spark, sf):
    """Q3, P10: the facts bundle of every app."""
    found, _ = _facts(spark, sf)
    vms = F.array_join(F.transform("worst", lambda w: w["vm_id"]), ",")
    return r6(found.select("app", "p95_now", "p95_base", vms.alias("worst_vms"), "alert_counts",
                           "alert_rules", "leaking"))


@query
def rca_facts_text(spark, sf):
    """Q3: the facts as text rows."""
    return rca.facts_lines(*_facts(spark, sf))


@query
def rca_verdict(spark, sf):
    """Q4: flags and cause of every app."""
    return r6(_judged(spark, sf).select(
        "app", "elevated", "factor", "worst_vm", "worst_latency", "heap_climbing", "heap_eta", "gc_high",
        "io_high", "cause"))


@query
def rca_narrative(spark, sf):
    """Q4: the summary text of every app."""
    return rca.narrative(_judged(spark, sf))


@query
def question_routing(spark, sf):
    """Q6, Q7: the app and the intent of every question."""
    m = dt.vm_metrics(spark, sf)
    return questions.route(dt.questions(spark, sf), answers.default_app(m, CFG), WORDS, HINTS).select(
        "conv_id", "turn", "app", "intent")


@query
def question_index_routing(spark, sf):
    """Q6, Q7: questions routed by a dictionary of all their longer words, the first in order winning."""
    q = dt.questions(spark, sf)
    words = q.select(F.explode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0))).alias("app")).filter(
        "length(app) >= 9").distinct()
    return questions.route_by_index(q, words.withColumn("position", col("app")), ["conv_id", "turn"], "none", HINTS).select(
        "conv_id", "turn", "app", "intent")


@query
def question_answers(spark, sf):
    """Q8, K5: the answer lines of every question; one of the apps has no samples."""
    m = dt.vm_metrics(spark, sf)
    found = answers.answer(
        dt.questions(spark, sf), m, dt.app_topology(spark, sf), CFG, ["app-1", "app-3", WORDS[1]], HINTS)
    return found.select("conv_id", "turn", "app", "intent", "line_no", "line")


@query
def guarded_sql(spark, sf):
    """An accepted statement over registered tables: the whole result."""
    tables.register(vm_metrics=dt.vm_metrics(spark, sf))
    return sqlguard.run(spark, """
        SELECT vm_id, count(*) AS n, round(max(heap_mb), 6) AS top_heap
        FROM vm_metrics GROUP BY vm_id ORDER BY n DESC, vm_id;""").rows


@query
def guarded_sql_alerts(spark, sf):
    """Alerts are registered for SQL as well."""
    tables.register(alerts=_alerts(dt.vm_metrics(spark, sf)))
    return sqlguard.guarded(
        spark, "SELECT rule, severity, count(*) AS n FROM alerts GROUP BY rule, severity")


# --- fleet health -----------------------------------------------------------

@query
def fleet_kpis(spark, sf):
    """Q10, A10, A11"""
    m = dt.vm_metrics(spark, sf)
    return health.kpis(m, _alerts(m))


@query
def fleet_grid(spark, sf):
    """Q11, J5, A13, K3"""
    m = dt.vm_metrics(spark, sf)
    return r6(health.grid(m, _alerts(m)))


@query
def vm_heap_series(spark, sf):
    """One VM's heap against its ceiling, at 45 units before the end."""
    found = health.heap_series(dt.vm_metrics(spark, sf), CFG, "vm-00003", 45.0)
    return r6(found.select(us("ts"), "heap_mb", "phase", "heap_cap_mb"))


@query
def alert_list(spark, sf):
    """Q13"""
    return detect.select_alerts(_alerts(dt.vm_metrics(spark, sf)))


@query
def default_chart_vm(spark, sf):
    """K7"""
    m = dt.vm_metrics(spark, sf)
    return health.default_vm(m, _alerts(m))


# --- quality and evaluation -------------------------------------------------

@query
def clipped_metrics(spark, sf):
    """P13, on metrics shifted below zero."""
    m = dt.vm_metrics(spark, sf)
    shifted = m.withColumns({name: (col(name) - 50).cast("float") for name in schema.METRICS})
    return r6(quality.clip_metrics(shifted).groupBy("app").agg(
        *[F.sum(col(name).cast("double")).alias(name) for name in schema.METRICS]))


@query
def fleet_downsample(spark, sf):
    """About a third of the suppliers, by nation."""
    f = dt.fleet(spark, sf)
    return quality.downsample_fleet(f, round(f.count() / 3))


@query
def fact_downsample(spark, sf):
    """The samples of a fleet cut to 40 VMs."""
    m = dt.vm_metrics(spark, sf)
    kept = quality.downsample_fleet(health.vm_list(m).select("vm_id", "app"), 40)
    return r6(quality.keep_vms(m, kept).groupBy("vm_id").agg(
        F.count("*").alias("n"), F.sum(col("heap_mb").cast("double")).alias("heap")))


@query
def first_vms_by_app_and_site(spark, sf):
    """R2"""
    return r6(quality.first_vms(dt.fleet(spark, sf), 2))


def _incidents(m: DataFrame) -> DataFrame:
    """Ten rule minutes from each VM's first crossing."""
    return quality.first_crossings(m, 95.0).select(
        F.lit("high-heap").alias("incident"), "vm_id", col("ts").alias("start_ts"),
        F.timestamp_micros(F.unix_micros("ts") + 10 * CFG.unit_us).alias("end_ts"))


@query
def incident_labels(spark, sf):
    """R3, J8"""
    m = dt.vm_metrics(spark, sf)
    labelled = quality.label_incidents(m, _incidents(m), CFG.unit_s)
    return r6(labelled.select(us("ts"), "vm_id", "incident", "elapsed_min"))


@query
def dense_incident_labels(spark, sf):
    """Every sample above a level opens an incident of its VM, long or short; samples in each, per VM."""
    m = dt.vm_metrics(spark, sf)
    opened = m.filter("heap_mb > 60").select(
        F.lit("above").alias("incident"), "vm_id", col("ts").alias("start_ts"),
        F.timestamp_micros(F.unix_micros("ts") + (1 + F.pmod(col("heap_mb").cast("long"), F.lit(7))) * (CFG.unit_us // 2)).alias("end_ts"))
    return r6(quality.label_incidents(m, opened, CFG.unit_s).groupBy("vm_id").agg(
        F.count("*").alias("n"), F.max("elapsed_min").alias("longest"), F.sum(F.floor("elapsed_min")).alias("total")))


@query
def first_cap_crossings(spark, sf):
    """R4"""
    found = quality.first_crossings(dt.vm_metrics(spark, sf), CFG.heap_cap_mb)
    return found.select(us("ts"), "vm_id", "app", "site", "level", "event_type", "message")


@query
def thinned_samples(spark, sf):
    """R5"""
    return quality.thin(dt.vm_metrics(spark, sf), 7).select(us("ts"), "vm_id")


@query
def baseline_band_audit(spark, sf):
    """R6"""
    m = dt.vm_metrics(spark, sf)
    return quality.band_audit(m, quality.app_means(m), 0.08)


@query
def detector_scores(spark, sf):
    """Alerts against VMs whose metrics did leave the normal range."""
    m = dt.vm_metrics(spark, sf)
    per_vm = m.groupBy("vm_id").agg(
        F.max("heap_mb").alias("top"), F.avg("error_rate_pct").alias("err"))
    labels = (per_vm.filter("top >= 250").select(F.lit("heap_leak").alias("rule"), "vm_id")
              .unionByName(per_vm.filter("err > 25").select(F.lit("error_storm").alias("rule"), "vm_id")))
    alerts = detect.replay(m, CFG, dt.REPLAY).filter(col("rule").isin("heap_leak", "error_storm"))
    return quality.score(alerts, labels)


@query
def alert_lead_times(spark, sf):
    """Rule minutes between the first alert and the first crossing."""
    m = dt.vm_metrics(spark, sf)
    timeline = detect.hits(m, CFG, "heap_leak", dt.REPLAY)
    found = quality.lead_times(timeline, quality.first_crossings(m, 150.0), CFG.unit_s)
    return r6(found.select("vm_id", us("first_alert"), us("crossing"), "lead_min"))


# --- ingest, sinks, streaming -----------------------------------------------

def _chunked(spark, m, label):
    """The fact as raw chunks in a fresh folder of the shared scratch space."""
    base = scratch_dir(spark, label)
    start = windows.data_bounds(m).start
    sinks.rechunk(m, f"{base}/raw", "vm_metrics", start, CHUNK_MINUTES)
    return base


@query
def chunk_slices(spark, sf):
    """Rows per chunk of three days."""
    m = dt.vm_metrics(spark, sf)
    start = windows.data_bounds(m).start
    return m.groupBy(sinks.chunk_id(col("ts"), start, CHUNK_MINUTES).alias("chunk")).agg(F.count("*").alias("n"))


@query
def ingested_days(spark, sf):
    """Chunks streamed into the lake twice; the second pass
    adds nothing."""
    base = _chunked(spark, dt.vm_metrics(spark, sf), "ingest")
    ingest.ingest_once(spark, f"{base}/raw", f"{base}/lake")
    ingest.ingest_once(spark, f"{base}/raw", f"{base}/lake")
    lake = tables.read_lake(spark, f"{base}/lake/vm_metrics", "vm_metrics")
    return r6(lake.groupBy(col("ts_day").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.sum(col("heap_mb").cast("double")).alias("heap")))


@query
def watched_ingest(spark, sf):
    """The streams in watch mode: they poll, take what has come, and are stopped."""
    base = _chunked(spark, dt.vm_metrics(spark, sf), "watch")
    query = ingest.ingest_stream(spark, f"{base}/raw", f"{base}/lake", "vm_metrics", watch_seconds=1)
    query.processAllAvailable()
    query.stop()
    lake = tables.read_lake(spark, f"{base}/lake/vm_metrics", "vm_metrics")
    return r6(lake.groupBy(col("ts_day").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.sum(col("heap_mb").cast("double")).alias("heap")))


@query
def ingest_ledger(spark, sf):
    """Rows recorded per chunk folder by the listing-based load."""
    base = _chunked(spark, dt.vm_metrics(spark, sf), "files")
    ingest.ingest_files(spark, f"{base}/raw", f"{base}/lake", "vm_metrics")
    return (ingest.read_ledger(spark, f"{base}/lake")
            .groupBy(F.regexp_extract("file_path", r"chunk=(\d+)", 1).cast("long").alias("chunk"), "table")
            .agg(F.sum("rows").alias("n")))


def _thirds(spark, m):
    """The fact in three parts by time."""
    bounds = windows.data_bounds(m)
    cuts = [bounds.start + (bounds.end - bounds.start) * i // 3 for i in (1, 2)]
    return bounds.start, [windows.between(m, hi=cuts[0]), windows.between(m, lo=cuts[0] + 1, hi=cuts[1]),
                          windows.between(m, lo=cuts[1] + 1)]


@query
def mixed_ingest(spark, sf):
    """Streams and hand loads by turns, with an empty chunk: rows per day, and the ledger's total."""
    start, parts = _thirds(spark, dt.vm_metrics(spark, sf))
    base = scratch_dir(spark, "mixed")
    raw, lake = f"{base}/raw", f"{base}/lake"
    loads = [lambda: ingest.ingest_stream(spark, raw, lake, "vm_metrics").awaitTermination(),
             lambda: ingest.ingest_files(spark, raw, lake, "vm_metrics"),
             lambda: ingest.ingest_stream(spark, raw, lake, "vm_metrics").awaitTermination()]
    for part, load in zip(parts, loads, strict=True):
        sinks.rechunk(part, raw, "vm_metrics", start, CHUNK_MINUTES)
        load()
    parts[0].limit(0).coalesce(1).write.parquet(f"{raw}/vm_metrics/chunk=empty")
    for _ in range(2):
        ingest.ingest_once(spark, raw, lake)
    known = ingest.read_ledger(spark, lake).agg(
        F.sum("rows").alias("ledger_rows"), F.count_if(col("rows") == 0).alias("empty_chunks"))
    days = tables.read_lake(spark, f"{lake}/vm_metrics", "vm_metrics").groupBy(
        col("ts_day").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return days.join(F.broadcast(known))  # one row


@query
def mixed_columns(spark, sf):
    """Chunks with different columns, read raw, by files and by stream."""
    start, parts = _thirds(spark, dt.vm_metrics(spark, sf))
    base = scratch_dir(spark, "columns")
    shapes = [["ts", "vm_id"], ["heap_mb", "vm_id", "ts"], ["ts", "vm_id", "heap_mb", "cpu_pct"]]
    for part, shape in zip(parts, shapes, strict=True):
        sinks.rechunk(part.select(*shape), f"{base}/raw", "vm_metrics", start, CHUNK_MINUTES)
    ingest.ingest_files(spark, f"{base}/raw", f"{base}/files", "vm_metrics")
    ingest.ingest_stream(spark, f"{base}/raw", f"{base}/stream", "vm_metrics").awaitTermination()
    ways = {"raw": tables.read_chunks(spark, f"{base}/raw/vm_metrics", "vm_metrics")} | {
        way: tables.read_lake(spark, f"{base}/{way}/vm_metrics", "vm_metrics") for way in ("files", "stream")}
    out = None
    for way, rows in ways.items():
        counts = rows.groupBy("vm_id").agg(F.count("*").alias("n"), F.count("heap_mb").alias("n_heap"),
                                           F.count("cpu_pct").alias("n_cpu"), F.count("app").alias("n_app"))
        counts = counts.withColumn("way", F.lit(way))
        out = counts if out is None else out.unionByName(counts)
    return out


def _two_batches(spark, sf):
    """A lake that got the first half of the fact, then the second."""
    m = dt.vm_metrics(spark, sf)
    bounds = windows.data_bounds(m)
    half = (bounds.start + bounds.end) // 2
    base = scratch_dir(spark, "halves")
    for part in (windows.between(m, hi=half), windows.between(m, lo=half + 1)):
        sinks.rechunk(part, f"{base}/raw", "vm_metrics", bounds.start, CHUNK_MINUTES)
        ingest.ingest_once(spark, f"{base}/raw", f"{base}/lake")
    return f"{base}/lake"


@query
def batch_history(spark, sf):
    """Batches with the total before and after each."""
    return history.last_batches(ingest.read_ledger(spark, _two_batches(spark, sf))).select(
        "table", "batch_id", "operation", "added", "previous_total", "total")


@query
def lake_as_of_batch(spark, sf):
    """Rows per app before the second batch, and now."""
    path = f"{_two_batches(spark, sf)}/vm_metrics"
    now = tables.read_lake(spark, path, "vm_metrics").groupBy("app").agg(F.count("*").alias("n_now"))
    then = tables.read_lake(spark, path, "vm_metrics", as_of_batch=0).groupBy("app").agg(
        F.count("*").alias("n_then"))
    return now.join(then, "app", "left")


@query
def lake_as_of_instant(spark, sf):
    """Rows per app as the lake was when its first batch had been committed, and now."""
    lake = _two_batches(spark, sf)
    first = ingest.read_ledger(spark, lake).filter("batch_id = 0").agg(F.max("ingested_at")).first()[0]
    now = tables.read_lake(spark, f"{lake}/vm_metrics", "vm_metrics").groupBy("app").agg(F.count("*").alias("n_now"))
    then = ingest.read_as_of(spark, lake, "vm_metrics", first).groupBy("app").agg(F.count("*").alias("n_then"))
    return now.join(then, "app", "left")


@query
def lake_kpis(spark, sf):
    """Q10, A10: the KPI row of a lake, from what each batch added; the fact is read for the alerts only."""
    lake = _two_batches(spark, sf)
    bounds = history.time_bounds(ingest.read_ledger(spark, lake))
    alerts = detect.detect(tables.read_lake(spark, f"{lake}/vm_metrics", "vm_metrics"), CFG, bounds=bounds, ordered=False)
    return health.kpis(ingest.read_partials(spark, lake), alerts)


@query
def lake_grid(spark, sf):
    """Q11, K3: the status grid of a lake's VMs, from what each batch added."""
    lake = _two_batches(spark, sf)
    return r6(health.grid(ingest.read_partials(spark, lake), _alerts(dt.vm_metrics(spark, sf))))


@query
def vm_history(spark, sf):
    """The samples and time span of each VM after the first batch, and now."""
    lake = _two_batches(spark, sf)
    then = ingest.read_partials(spark, lake, as_of_batch=0).select("vm_id", "app", col("n_samples").alias("n_then"))
    return (ingest.read_partials(spark, lake).join(then, ["vm_id", "app"], "left")
            .select("vm_id", "app", "n_samples", us("first_ts"), us("last_ts"), "n_then"))


@query
def lake_heap_series(spark, sf):
    """One VM's heap from a lake whose files are laid out by VM."""
    lake = _two_batches(spark, sf)
    found = health.heap_series(tables.read_lake(spark, f"{lake}/vm_metrics", "vm_metrics"), CFG, "vm-00003", 45.0)
    return r6(found.select(us("ts"), "heap_mb", "phase", "heap_cap_mb"))


@query
def sketched_latency(spark, sf):
    """Percentiles and distinct VMs from daily sketches, and whether they keep their error bounds."""
    m = dt.vm_metrics(spark, sf)
    path = scratch_dir(spark, "sketches")
    sketches.daily(m).write.partitionBy("day").parquet(path)
    found = checkpoint(sketches.answers(spark.read.parquet(path)))
    errors = sketches.rank_errors(m, found)
    return found.join(F.broadcast(errors), "app").select(  # a row for each app
        "app", "n", (col("rank_error") <= 0.02).alias("rank_in_bound"), (col("vm_error") <= 0.04).alias("vms_in_bound"))


@query
def lake_detect(spark, sf):
    """Detection over the ingested lake, bounds taken from the ledger."""
    base = _chunked(spark, dt.vm_metrics(spark, sf), "detect")
    lake = f"{base}/lake"
    ingest.ingest_once(spark, f"{base}/raw", lake)
    bounds = history.time_bounds(ingest.read_ledger(spark, lake))
    found = detect.detect(tables.read_lake(spark, f"{lake}/vm_metrics", "vm_metrics"), CFG, bounds=bounds)
    return found.select("severity", "rule", "vm_id", "app")


@query
def catalog_load(spark, sf):
    """A fresh namespace, loaded, detected from, and counted table by table."""
    namespace = f"fleetlens_{uuid.uuid4().hex}"
    m = dt.vm_metrics(spark, sf)
    topology = graph.build_topology(dt.fleet(spark, sf), dt.edge_list(spark, sf))
    sinks.ensure_tables(spark, namespace)
    for table, rows in (("vm_metrics", m), ("app_events", dt.app_events(spark, sf)), ("topology", topology), ("topology", topology)):
        sinks.load_table(rows, namespace, table)
    sinks.load_table(_alerts(tables.read_catalog(spark, namespace, "vm_metrics")), namespace, "alerts")
    p1 = tables.read_catalog(spark, namespace, "alerts").agg(F.count_if(col("severity") == "P1").alias("n_p1"))
    found = checkpoint(sinks.table_counts(spark, namespace).join(F.broadcast(p1)))  # one row
    spark.sql(f"DROP DATABASE {namespace} CASCADE")
    return found


@query
def hourly_chunks(spark, sf):
    """The raw dt/hour layout, written and counted by partition."""
    path = sinks.write_chunks(dt.vm_metrics(spark, sf), scratch_dir(spark, "hourly"), "vm_metrics")
    return (spark.read.parquet(path)
            .groupBy(col("dt").cast("string").alias("dt"), col("hour").cast("long").alias("hour"))
            .agg(F.count("*").alias("n")))


@query
def app_event_counts(spark, sf):
    """The event table by app, level and type."""
    return dt.app_events(spark, sf).groupBy("app", "site", "level", "event_type").agg(F.count("*").alias("n"))


@query
def topology_overwrite(spark, sf):
    """The dimension written twice, read back once."""
    path = scratch_dir(spark, "topology")
    topology = graph.build_topology(dt.fleet(spark, sf), dt.edge_list(spark, sf))
    for _ in range(2):
        sinks.write_dimension(topology, path)
    return tables.read_chunks(spark, path, "topology").groupBy("app", "depends_on_app").agg(
        F.count("*").alias("n_vms"))


@query
def alerts_json(spark, sf):
    """Alerts through the JSON sink, all columns."""
    path = scratch_dir(spark, "alerts-json")
    sinks.write_alerts_json(_alerts(dt.vm_metrics(spark, sf)), path)
    back = spark.read.schema("ts string, severity string, rule string, vm_id string, app string, headline string, "
                             "evidence_json string, action string").json(path)
    return back.select("ts", "severity", "rule", "vm_id", "app", "headline",
                       F.size(F.json_object_keys("evidence_json")).cast("long").alias("n_evidence"), "action")


@query
def alerts_table(spark, sf):
    """Two appends of one instant, the second replacing the first."""
    path = scratch_dir(spark, "alerts")
    found = _alerts(dt.vm_metrics(spark, sf))
    for _ in range(2):
        sinks.append_alerts(found, path, replace_instant=True)
    return sinks.read_alerts(spark, path).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query
def alert_digest(spark, sf):
    """The alert messages."""
    return sinks.digest(_alerts(dt.vm_metrics(spark, sf))).select(
        "page", "n_alerts", "color", "headline", "text")


def _stream(spark, sf):
    base = _chunked(spark, dt.vm_metrics(spark, sf), "live")
    return (spark.readStream.schema(schema.VM_METRICS).option("recursiveFileLookup", "true")
            .parquet(f"{base}/raw/vm_metrics")), base


def _watched(alerts):
    """Whole alert rows; evidence as its rounded values, by key."""
    values = F.array_sort(F.map_entries(F.from_json("evidence_json", "map<string,double>")))
    text = F.array_join(F.transform(values, lambda e: F.format_string("%s=%.3f", e["key"], e["value"] + F.lit(0.0))), ";")
    return alerts.select(us("ts"), "severity", "rule", "vm_id", "app", "headline", text.alias("evidence"), "action")


@query
def live_vm_alerts(spark, sf):
    """The per-VM rules as a stream of panes, against a stored baseline."""
    m = dt.vm_metrics(spark, sf)
    stream, base = _stream(spark, sf)
    baseline = checkpoint(live.vm_baseline(m, windows.instants(m, CFG)[0]))
    live.watch_vms(stream, baseline, base, CFG, LIVE_SLIDE_S, LIVE_DELAY).awaitTermination()
    return _watched(live.live_alerts(spark, base))


@query
def live_recent_alerts(spark, sf):
    """What the stream finds by the recent-window rules."""
    return live_vm_alerts(spark, sf).filter("rule <> 'heap_leak'")


@query
def live_heap_alerts(spark, sf):
    """What the stream finds by the heap-leak rule."""
    return live_vm_alerts(spark, sf).filter("rule = 'heap_leak'")


@query
def live_latency_alerts(spark, sf):
    """The app p95 rule on a stream of bucket counts; exact by a second look at one bucket."""
    m = dt.vm_metrics(spark, sf)
    stream, base = _stream(spark, sf)
    baseline = checkpoint(live.app_baseline(app_latency(m, CFG, windows.instants(m, CFG))))
    live.watch_latency(stream, lambda: tables.read_chunks(spark, f"{base}/raw/vm_metrics", "vm_metrics"), baseline, base, CFG,
                       LIVE_SLIDE_S, LIVE_DELAY).awaitTermination()
    return _watched(live.live_alerts(spark, base))


@query
def sweep_alerts(spark, sf):
    """Alerts of 440 instants, a quarter of a rule minute apart, from panes."""
    asofs = [i / 4 for i in range(440)]
    return detect.sweep(dt.vm_metrics(spark, sf), CFG, asofs).select("asof", us("ts"), "severity", "rule", "vm_id", "app")
