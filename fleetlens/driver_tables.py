"""The telemetry tables, as views over the driver's parquet tables.

``events`` plays the metric fact: one user is one VM, the event value is the
metric. It spans 30 days, so one rule minute is stretched to six hours (the
whole is then the usual 120 rule minutes). ``nation`` and ``supplier`` play the
topology, ``conversations`` the questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens import schema
from fleetlens.config import Thresholds

# Thresholds that fire on these tables.
CONFIG = Thresholds(
    heap_cap_mb=100.0, heap_min_slope=0.5, heap_min_corr=0.2, heap_p1_eta_min=10.0,
    io_z=0.5, retrans_pct=5.0, latency_x=1.05, error_p1_pct=40.0,
    rca_latency_x=1.02, rca_heap_slope=0.5, rca_gc_ms=50.0, rca_io_ms=55.0,
    unit_s=21_600.0)
REPLAY = [45.0, 30.0, 15.0, 0.0]

# ts is declared as a timestamp so that time filters reach the Parquet reader.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _ids() -> list[Column]:
    """vm_id, app and site of a user."""
    user = F.col("user_id")
    return [F.concat(F.lit("vm-"), F.lpad(user.cast("string"), 5, "0")).alias("vm_id"),
            F.concat(F.lit("app-"), (user % 8).cast("string")).alias("app"),
            F.when(user % 2 == 0, "dc-east").otherwise("dc-west").alias("site")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def vm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, k = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    wide = events(spark, sf_dir).select(
        "ts", *_ids(),
        value.alias("cpu_pct"), value.alias("heap_mb"), k.alias("gc_pause_ms"),
        value.alias("disk_io_await_ms"), k.alias("disk_iops"), k.alias("net_mbps"),
        (value / 10).alias("net_retrans_pct"), value.alias("app_latency_ms"),
        F.when(F.col("event_type") == "error", 100.0).otherwise(0.0).alias("error_rate_pct"))
    return schema.conform(wide, schema.VM_METRICS)


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "ts", *_ids(),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("WARN").alias("level"),
        "event_type", F.col("props").alias("message"))
    return schema.conform(rows, schema.APP_EVENTS)


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation depends on the one at half its key: a binary tree."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parent = n.select(F.col("n_nationkey").alias("parent"), F.col("n_name").alias("depends_on_app"))
    child = n.filter("n_nationkey >= 1").select(
        F.expr("(n_nationkey - 1) div 2").alias("parent"), F.col("n_name").alias("app"))
    return child.join(parent, "parent").select("app", "depends_on_app")


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as VMs: app is the nation, site the region."""
    s, n, r = (table(spark, sf_dir, name) for name in ("supplier", "nation", "region"))
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_name").alias("vm_id"), F.col("n_name").alias("app"), F.col("r_name").alias("site")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"))


def app_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topology of the event apps: app k needs app (k - 1) div 2, on every VM."""
    number = F.col("user_id") % 8
    return (events(spark, sf_dir).filter(number >= 1).select(
        *_ids(),
        F.concat(F.lit("app-"), F.floor((number - 1) / 2).cast("string")).alias("depends_on_app")).distinct())
