"""The shape of the plans: what must hold whatever the data size."""

import re

import pytest

from fleetlens.config import Thresholds
from fleetlens.operators import health, quality, rca
from fleetlens.operators.features import app_latency, vm_features
from fleetlens.operators.windows import instants
from fleetlens.plans import detect
from fleetlens.schema import VM_METRICS
from tests import fleet

CFG = Thresholds()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "m")
    fleet.metrics(spark, incidents=fleet.MIX).write.parquet(path)
    return spark.read.schema(VM_METRICS).parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_reads_few_narrow_columns(spark, stored):
    text = plan(detect.detect(stored, CFG))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert len(scans) <= 3
    for columns in scans:
        names = {c.split(":")[0] for c in columns.split(",")}
        assert not names & {"cpu_pct", "net_mbps", "site"}
    assert text.count("PushedFilters: [IsNotNull(ts)") == len(scans)


def test_fact_aggregations_are_hash_based(stored):
    points = instants(stored, CFG)
    for df in (app_latency(stored, CFG, points), quality.first_crossings(stored, 1.0),
               quality.band_audit(stored, quality.app_means(stored), 0.1), health.vm_list(stored)):
        text = plan(df)
        # the aggregate next to a scan never sorts its input
        for block in re.split(r"(?=FileScan)", text)[:-1]:
            nearest = re.findall(r"(SortAggregate|HashAggregate|ObjectHashAggregate)\(", block)
            assert nearest and nearest[-1] == "HashAggregate"
    features = plan(vm_features(stored, CFG, points, fleet=stored.select("vm_id", "app")))
    assert "partial_regr_slope" in features
    assert re.search(r"HashAggregate\(keys=\[[^\]]*\], functions=\[[^\n]*partial_regr_slope", features)
    assert not re.search(r"SortAggregate\([^\n]*partial_regr_slope", features)


def test_several_instants_do_not_multiply_scans_or_shuffles(stored):
    one, two, six = (plan(vm_features(stored, CFG, instants(stored, CFG, asofs))) for asofs in (
        [0.0], [30.0, 0.0], [75.0, 60.0, 45.0, 30.0, 15.0, 0.0]))
    for node in ("FileScan", "Exchange hashpartitioning"):
        assert two.count(node) == six.count(node)
    assert one.count("FileScan") == two.count("FileScan")
    # one more shuffle, of one row per VM and window: it hands a shared baseline
    # to the instants that use it, instead of aggregating it once per instant
    assert two.count("Exchange hashpartitioning") <= one.count("Exchange hashpartitioning") + 1


def test_no_plan_pairs_rows_or_runs_python(stored):
    alerts = detect.detect(stored, CFG, ordered=False)
    m = stored
    for df in (alerts, detect.replay(m, CFG), rca.verdict(rca.facts(m, CFG, alerts), CFG), health.kpis(m, alerts),
               health.grid(m, alerts), quality.thin(m, 10), app_latency(m, CFG, instants(m, CFG))):
        text = plan(df)
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEvalPython",
                     "MapInPandas", "FlatMapGroups"):
            assert node not in text


def test_top_k_is_cut_before_its_shuffle(stored):
    text = plan(rca.worst_vms(vm_features(stored, CFG, instants(stored, CFG)), CFG))
    assert "WindowGroupLimit" in text and "Partial" in text
