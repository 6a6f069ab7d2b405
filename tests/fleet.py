"""Closed-form fixture data: a fleet, its healthy metrics, and incidents on top.

metric = mean + std * sqrt(2) * sin(12.9898 vm + 78.233 sample + k), so the
values are bounded and repeatable without a seed.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fleetlens import schema

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
START_US = int(START.timestamp() * 1_000_000)
MINUTE = 60_000_000
STEP_S = 30

BASELINE = {
    "cpu_pct": 30.0, "heap_mb": 1800.0, "gc_pause_ms": 30.0, "disk_io_await_ms": 8.0, "disk_iops": 1500.0,
    "net_mbps": 100.0, "net_retrans_pct": 0.3, "app_latency_ms": 80.0, "error_rate_pct": 0.2}
FLEET = {"patient-onboarding": 4, "postgres-db": 3, "billing-svc": 3, "hl7-ingest": 3}
EDGES = [("patient-onboarding", "ehr-api"), ("ehr-api", "postgres-db"),
         ("hl7-ingest", "kafka"), ("kafka", "ehr-api")]
# The full default graph.
ALL_EDGES = [*EDGES, ("billing-svc", "postgres-db"), ("scheduler-svc", "ehr-api")]


def vms(spark, fleet=None):
    rows, number = [], 0
    for app, count in (fleet or FLEET).items():
        for i in range(count):
            rows.append((number, f"{app}-{i:04d}", app, ["dc-east", "dc-west"][i % 2]))
            number += 1
    return spark.createDataFrame(rows, "vm int, vm_id string, app string, site string")


def metrics(spark, n_samples=180, fleet=None, incidents=(), noise=0.05, **baseline):
    """incidents: (metric, app, first n VMs, start minute, added at once, added per minute)."""
    means = {**BASELINE, **baseline}
    wave = F.sin(12.9898 * F.col("vm") + 78.233 * F.col("sample") + F.col("k"))
    df = vms(spark, fleet).withColumn("sample", F.explode(F.expr(f"sequence(0L, {n_samples - 1}L)")))
    minute = F.col("sample") * (STEP_S / 60.0)
    nth = F.substring("vm_id", -4, 4).cast("int")
    columns = [F.timestamp_micros(F.lit(START_US) + F.col("sample") * STEP_S * 1_000_000).alias("ts"),
               "vm_id", "app", "site"]
    for k, (name, mean) in enumerate(means.items()):
        value = F.lit(mean) + mean * noise * (2 ** 0.5) * F.sin(
            12.9898 * F.col("vm") + 78.233 * F.col("sample") + F.lit(float(k)))
        for metric, app, count, start, jump, slope in incidents:
            if metric == name:
                hit = (F.col("app") == app) & (nth < count) & (minute >= start)
                value = value + F.when(hit, F.lit(float(jump)) + (minute - start) * slope).otherwise(0.0)
        columns.append(value.alias(name))
    return schema.conform(df.select(columns), schema.VM_METRICS)


MIX = [
    ("heap_mb", "patient-onboarding", 2, 5, 0, 25.0),
    ("disk_io_await_ms", "postgres-db", 1, 40, 0, 4.0),
    ("net_retrans_pct", "hl7-ingest", 1, 40, 8.0, 0),
    ("error_rate_pct", "billing-svc", 1, 40, 6.0, 0),
]


def rows(spark, samples):
    """Metric rows from dicts: minute plus any columns; the rest is null."""
    data = []
    for sample in samples:
        values = {"vm_id": "vm-0", "app": "app-0", "site": "dc-east", **sample}
        ts = START + timedelta(minutes=values.pop("minute"))
        data.append(tuple(
            ts if f.name == "ts" else
            (None if values.get(f.name) is None else
             (float(values[f.name]) if f.name in schema.METRICS else values[f.name]))
            for f in schema.VM_METRICS.fields))
    return spark.createDataFrame(data, schema.VM_METRICS)


def topology(spark, edges=EDGES, per_app=2):
    apps = sorted({a for a, _ in edges})
    data = [(f"{app}-{i:04d}", app, "dc-east", dep) for app, dep in edges for i in range(per_app)]
    assert apps
    return spark.createDataFrame(data, schema.TOPOLOGY)
