"""The data contract: declared schemas and the projection onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Table layouts.
METRICS = [
    "cpu_pct", "heap_mb", "gc_pause_ms", "disk_io_await_ms", "disk_iops",
    "net_mbps", "net_retrans_pct", "app_latency_ms", "error_rate_pct",
]


def _schema(ts: bool, strings: list[str], floats: list[str] = ()) -> T.StructType:
    fields = [T.StructField("ts", T.TimestampType())] if ts else []
    fields += [T.StructField(name, T.StringType()) for name in strings]
    fields += [T.StructField(name, T.FloatType()) for name in floats]
    return T.StructType(fields)


VM_METRICS = _schema(True, ["vm_id", "app", "site"], METRICS)
APP_EVENTS = _schema(True, ["vm_id", "app", "site", "level", "event_type", "message"])
TOPOLOGY = _schema(False, ["vm_id", "app", "site", "depends_on_app"])
ALERTS = _schema(
    True, ["severity", "rule", "vm_id", "app", "headline", "evidence_json", "action"])

FACTS = {"vm_metrics": VM_METRICS, "app_events": APP_EVENTS}
TABLES = {**FACTS, "topology": TOPOLOGY, "alerts": ALERTS}

# Columns a lake table carries beside its contract.
LAKE_COLUMNS = ["ts_day", "_batch_id", "_source_file"]


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType, keep: list[str] = ()) -> DataFrame:
    """Project onto the contract: declared order and types, nothing else.

    Helper columns (dt, hour, ...) are dropped unless named in ``keep``, missing
    columns become null, and nanosecond longs become microsecond timestamps.
    """
    have = {field.name: field.dataType for field in df.schema.fields}
    columns = []
    for field in schema.fields:
        if field.name not in have:
            column = F.lit(None)
        elif isinstance(field.dataType, T.TimestampType) and isinstance(have[field.name], T.LongType):
            column = F.timestamp_micros(F.floor(F.col(field.name) / 1000))
        else:
            column = F.col(field.name)
        if have.get(field.name) != field.dataType:
            column = column.cast(field.dataType).alias(field.name)
        columns.append(column)
    columns += [F.col(name) for name in keep if name in have and name not in schema.names]
    return df.select(columns)
