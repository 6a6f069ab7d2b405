import pytest

from fleetlens.operators import graph
from fleetlens.plans import answers
from fleetlens.schema import ALERTS, TOPOLOGY, empty
from tests import fleet


def edge_frame(spark, pairs):
    return spark.createDataFrame(pairs, "app string, depends_on_app string")


def depths(df):
    return {r.app: r.depth for r in df.collect()}


def test_edges_are_distinct_and_named(spark):
    t = fleet.topology(spark).unionByName(spark.createDataFrame(
        [("x-0", "x", "dc-east", ""), ("y-0", "y", "dc-east", None)], TOPOLOGY))
    assert sorted(map(tuple, graph.edges(t).collect())) == sorted(fleet.EDGES)


def test_topology_is_fleet_times_edges(spark):
    vms = fleet.vms(spark, {"patient-onboarding": 3, "postgres-db": 2}).select("vm_id", "app", "site")
    t = graph.build_topology(vms, edge_frame(spark, fleet.EDGES))
    # apps without dependencies have no rows
    assert {(r.app, r.depends_on_app) for r in t.collect()} == {("patient-onboarding", "ehr-api")}
    assert t.count() == 3


def test_downstream_and_upstream(spark):
    e = graph.edges(fleet.topology(spark))
    db, front = graph.roots_of(spark, "postgres-db"), graph.roots_of(spark, "patient-onboarding")
    assert depths(graph.reach(e, db)) == {"ehr-api": 1, "kafka": 2, "patient-onboarding": 2, "hl7-ingest": 3}
    assert depths(graph.reach(e, db, graph.UPSTREAM)) == {}
    assert depths(graph.reach(e, front, graph.UPSTREAM)) == {"ehr-api": 1, "postgres-db": 2}
    assert depths(graph.reach(e, db, max_depth=1)) == {"ehr-api": 1}


def test_full_fleet_blast_radius(spark):
    e = edge_frame(spark, fleet.ALL_EDGES)
    assert depths(graph.reach(e, graph.roots_of(spark, "postgres-db"))) == {
        "ehr-api": 1, "billing-svc": 1, "patient-onboarding": 2, "kafka": 2, "scheduler-svc": 2, "hl7-ingest": 3}


def test_cycles_and_self_loops_end(spark):
    e = edge_frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("d", "a")])
    assert depths(graph.reach(e, graph.roots_of(spark, "a"))) == {"c": 1, "d": 1, "b": 2}
    paths = graph.paths(e, "a", "b").collect()
    assert [r.path for r in paths] == [["a", "c", "b"]]


def test_two_paths_of_different_length(spark):
    e = edge_frame(spark, [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("z", "a")])
    root = graph.roots_of(spark, "a")
    assert depths(graph.reach(e, root)) == {"b": 1, "c": 1, "z": 1, "d": 2}
    hops = {(r.app, r.hops) for r in graph.hops(e, root, max_hops=5).collect()}
    assert hops == {("b", 1), ("c", 1), ("z", 1), ("c", 2), ("d", 2), ("d", 3)}
    assert {(r.app, r.hops) for r in graph.hops(e, root, max_hops=1).collect()} == {("b", 1), ("c", 1), ("z", 1)}
    assert sorted(r.path for r in graph.paths(e, "a", "d").collect()) == [["a", "b", "c", "d"], ["a", "c", "d"]]
    assert graph.paths(e, "d", "a").count() == 0


def test_deep_chain(spark):
    e = edge_frame(spark, [(f"n{i + 1}", f"n{i}") for i in range(12)])
    got = depths(graph.reach(e, graph.roots_of(spark, "n0")))
    assert got == {f"n{i}": i for i in range(1, 13)}


def test_many_roots_at_once(spark):
    e = edge_frame(spark, fleet.ALL_EDGES)
    got = {}
    for r in graph.reach(e, graph.all_roots(e)).collect():
        got.setdefault(r.root, {})[r.app] = r.depth
    assert got["ehr-api"] == {"patient-onboarding": 1, "kafka": 1, "scheduler-svc": 1, "hl7-ingest": 2}
    assert "hl7-ingest" not in got


def test_vms_in_radius_use_the_fleet(spark):
    e = edge_frame(spark, fleet.EDGES)
    vms = fleet.vms(spark, {"ehr-api": 2, "kafka": 1, "postgres-db": 2, "hl7-ingest": 1})
    got = {(r.app, r.vm_id) for r in graph.vms_in_radius(e, graph.roots_of(spark, "postgres-db"), vms).collect()}
    assert got == {("ehr-api", "ehr-api-0000"), ("ehr-api", "ehr-api-0001"), ("kafka", "kafka-0000"),
                   ("hl7-ingest", "hl7-ingest-0000")}


def _alerts(spark, *tags):
    return spark.createDataFrame(
        [(None, sev, rule, "", app, "", "", "") for app, sev, rule in tags], ALERTS)


def test_trace_carries_alerts(spark):
    alerts = _alerts(spark, ("ehr-api", "P2", "io_spike"), ("ehr-api", "P1", "heap_leak"),
                     ("ehr-api", "P2", "io_spike"), ("other", "P1", "heap_leak"))
    rows = {(r.direction, r.app): r for r in graph.trace(
        fleet.topology(spark), graph.roots_of(spark, "postgres-db"), alerts).collect()}
    assert rows[("downstream", "ehr-api")].tags == "P1:heap_leak, P2:io_spike"
    assert rows[("downstream", "kafka")].tags == ""
    assert not [key for key in rows if key[0] == "upstream"]


def test_blast_lines_read_like_a_report(spark):
    lines = answers.blast_lines(fleet.topology(spark), graph.roots_of(spark, "ehr-api"),
                                _alerts(spark, ("kafka", "P1", "heap_leak")))
    text = [r.line for r in lines.orderBy("line_no", "line").collect()]
    assert text[:8] == [
        "## Blast radius: ehr-api", "", "app: ehr-api", "downstream (impacted if ehr-api fails):",
        "  depth 1: kafka  ALERTS: P1:heap_leak", "  depth 1: patient-onboarding", "  depth 2: hl7-ingest",
        "upstream (ehr-api depends on):"]
    assert text[8] == "  depth 1: postgres-db"
    alone = answers.blast_lines(fleet.topology(spark), graph.roots_of(spark, "nobody"), empty(spark, ALERTS))
    assert [r.line for r in alone.collect()].count("  (none)") == 2


def test_unknown_direction(spark):
    with pytest.raises(ValueError):
        graph.reach(edge_frame(spark, fleet.EDGES), graph.roots_of(spark, "a"), "sideways")


def test_hops_use_no_edge_twice(spark):
    """On two nodes that need each other, a walk is back after two steps and then stuck."""
    e = edge_frame(spark, [("a", "b"), ("b", "a")])
    assert sorted((r.app, r.hops) for r in graph.hops(e, graph.roots_of(spark, "a")).collect()) == [("a", 2), ("b", 1)]
    both = edge_frame(spark, [("b", "a"), ("a", "b"), ("c", "b")])
    assert sorted((r.app, r.hops) for r in graph.hops(both, graph.roots_of(spark, "a")).collect()) == [
        ("a", 2), ("b", 1), ("c", 2)]
