"""Writers: raw layout, tables, alerts, digest."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens import schema
from fleetlens.functions.sizing import small_side
from fleetlens.functions.ranking import position_by_sort
from fleetlens.functions.stats import severity_rank

# Alerts per digest message.
DIGEST_PAGE = 500


def with_hours(df: DataFrame) -> DataFrame:
    return df.withColumns({"dt": F.date_format("ts", "yyyy-MM-dd"), "hour": F.date_format("ts", "HH")})


def balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of one output folder together, as far as that leaves tasks of even
    size: the adaptive planner splits a busy folder and merges quiet ones."""
    return df.hint("rebalance", *[F.col(name) for name in columns])


def write_chunks(df: DataFrame, root: str, table: str) -> str:
    """Raw layout: <root>/<table>/dt=.../hour=.../part-*.parquet, appended."""
    path = f"{root.rstrip('/')}/{table}"
    (balanced(with_hours(df), "dt", "hour")
     .write.mode("append").partitionBy("dt", "hour").parquet(path))
    return path


def chunk_id(ts: Column, start_us: int, minutes: float) -> Column:
    """Number of the fixed-length time slice a sample belongs to."""
    return F.floor((F.unix_micros(ts) - F.lit(start_us)) / F.lit(minutes * 60e6)).cast("long")


def rechunk(df: DataFrame, root: str, table: str, start_us: int, minutes: float) -> str:
    """Write a table as raw chunks of ``minutes`` each: <root>/<table>/chunk=N/, appended."""
    path = f"{root.rstrip('/')}/{table}"
    sliced = df.withColumn("chunk", chunk_id(F.col("ts"), start_us, minutes))
    balanced(sliced, "chunk").write.mode("append").partitionBy("chunk").parquet(path)
    return path


def write_dimension(df: DataFrame, path: str, table: str = "topology") -> int:
    """Overwrite a dimension; returns the rows written. A small one becomes one
    file, a large one as many as its size asks for."""
    rows = schema.conform(df, schema.TABLES[table])
    balanced(rows).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path).count()


def ensure_tables(spark: SparkSession, namespace: str) -> None:
    """Create the namespace and its tables if missing: facts and alerts by day,
    the topology unpartitioned."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace}")
    for name, contract in schema.TABLES.items():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in contract.fields)
        if name == "topology":
            layout = f"({columns}) USING parquet"
        else:
            layout = f"({columns}, ts_day DATE) USING parquet PARTITIONED BY (ts_day)"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {namespace}.{name} {layout}")


def load_table(df: DataFrame, namespace: str, table: str) -> None:
    """Put rows into a catalog table: the topology replaces what is there, all others are added."""
    rows = schema.conform(df, schema.TABLES[table])
    if table == "topology":
        return rows.write.mode("overwrite").insertInto(f"{namespace}.{table}")
    rows = balanced(rows.withColumn("ts_day", F.to_date("ts")), "ts_day")
    return rows.write.mode("append").insertInto(f"{namespace}.{table}")


def table_counts(spark: SparkSession, namespace: str) -> DataFrame:
    """(table, n): the rows of every table of a namespace."""
    out = None
    for name in schema.TABLES:
        one = spark.table(f"{namespace}.{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def write_alerts_json(alerts: DataFrame, path: str) -> None:
    """One JSON record per line, ts as text."""
    alerts.withColumn("ts", F.col("ts").cast("string")).write.mode("overwrite").json(path)


def append_alerts(alerts: DataFrame, path: str, replace_instant: bool = False, instant: datetime | None = None) -> None:
    """Add alerts to the table at ``path``, partitioned by day and run.

    By default every run appends, and no alerts means no change. With
    ``replace_instant`` the alerts that earlier runs have at the same instants no
    longer count; name the ``instant`` of the run, so that one that has lost all its
    alerts is replaced as well.
    """
    spark, run = alerts.sparkSession, uuid.uuid4().hex
    rows = alerts.select(*schema.ALERTS.names, F.to_date("ts").alias("ts_day"))
    rows.withColumn("_run", F.lit(run)).write.mode("append").partitionBy("ts_day", "_run").parquet(f"{path}/rows")
    marks = spark.createDataFrame([(None,)], "instant timestamp")
    if replace_instant:
        marks = marks.unionAll(alerts.select("ts").distinct())
        if instant is not None:
            marks = marks.unionAll(spark.createDataFrame([(instant,)], "instant timestamp")).distinct()
    (marks.select(F.lit(run).alias("_run"), "instant", F.current_timestamp().alias("written"))
     .coalesce(1).write.mode("append").parquet(f"{path}/runs"))


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of all finished runs, without those whose instant a later run has replaced."""
    full = T.StructType([*schema.ALERTS.fields, T.StructField("ts_day", T.DateType()), T.StructField("_run", T.StringType())])
    try:
        rows = spark.read.schema(full).parquet(f"{path}/rows")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return schema.empty(spark, schema.ALERTS)
        raise
    marks = (spark.read.schema("_run string, instant timestamp, written timestamp").parquet(f"{path}/runs")
             .withColumn("at", F.struct("written", "_run")))
    runs = marks.filter("instant IS NULL").select("_run", "at")
    last = marks.groupBy("instant").agg(F.max("at").alias("replaced")).filter("instant IS NOT NULL")
    return (rows.join(small_side(runs), "_run").join(small_side(last), F.col("ts") == F.col("instant"), "left")
            .filter(F.col("replaced").isNull() | (F.col("at") >= F.col("replaced"))).select(*schema.ALERTS.names))


def digest(alerts: DataFrame, asof: float = 0.0, page_size: int = DIGEST_PAGE) -> DataFrame:
    """(page, n_alerts, color, text, payload): the alert summary as messages.

    Every alert is in exactly one message, in alert order. A message holds at
    most ``page_size`` lines, so none of them grows with the number of alerts;
    the count in the headline is that of all alerts. Without alerts there is one
    all-clear message.
    """
    spark = alerts.sparkSession
    line = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("rule"), F.lit(" — "), F.col("headline"))
    rows = alerts.select(
        F.lit(0).alias("one"), severity_rank(F.col("severity")).alias("rank"), "rule", "vm_id", "app",
        line.alias("line"))
    placed = position_by_sort(rows, ["one"], ["rank", "rule", "vm_id", "app", "line"], "at")
    total = placed.count()
    minutes = f"{asof:.0f}"
    if total == 0:
        color, text = "#2eb886", f":white_check_mark: No alerts (asof -{minutes}m)."
        pages = spark.createDataFrame([(0, "")], "page long, lines string")
    else:
        color, text = "#d00000", f":rotating_light: {total} alert(s) (asof -{minutes}m)"
        pages = (placed.groupBy(F.floor(F.col("at") / page_size).alias("page"))
                 .agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("x"))
                 .select("page", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("lines")))
    payload = F.to_json(F.struct(
        F.lit(text).alias("text"),
        F.array(F.struct(F.lit(color).alias("color"), F.col("lines").alias("text"))).alias("attachments")))
    return pages.select("page", F.lit(total).alias("n_alerts"), F.lit(color).alias("color"),
                        F.lit(text).alias("headline"), F.col("lines").alias("text"), payload.alias("payload"))
