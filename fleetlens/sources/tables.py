"""Reading telemetry tables: Parquet folders, catalog tables, raw chunks."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens import schema
from fleetlens.sources.files import names

# Raised by a scan of a folder that is missing or holds no Parquet file.
NO_FILES = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def raw_schema(spark: SparkSession, paths: list[str], contract: T.StructType) -> T.StructType:
    """The contract, with the physical types that a file has for its columns.

    Every contract column is read from every file that has it; which columns the
    looked-up file has does not matter.
    """
    try:
        found = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
                 .parquet(*paths).schema)
    except AnalysisException as error:
        if error.getCondition() in NO_FILES:
            return contract
        raise
    have = {field.name: field.dataType for field in found.fields}

    def read_as(field: T.StructField) -> T.DataType:
        kind = have.get(field.name, field.dataType)
        # Chunks may hold a metric as float or as double: both can be read as double.
        return T.DoubleType() if isinstance(kind, T.FloatType) else kind

    return T.StructType([T.StructField(f.name, read_as(f)) for f in contract.fields])


def read_chunks(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A raw table folder, at any depth, projected onto the contract.

    Folder names such as dt= and hour= are not turned into columns: a chunk is
    filed under its first timestamp, so they may be wrong for later rows. Chunks
    may have different columns; one that a chunk does not have is null there. A
    folder without files gives an empty table of the right type.
    """
    contract = schema.TABLES[table]
    try:
        raw = (spark.read.schema(raw_schema(spark, [path], contract)).option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.parquet").parquet(path))
    except AnalysisException as error:
        if error.getCondition() in NO_FILES:
            return schema.empty(spark, contract)
        raise
    return schema.conform(raw, contract)


def claims_path(lake: str, table: str) -> str:
    return f"{lake.rstrip('/')}/_ingest/claims/{table}"


def ledger_path(lake: str) -> str:
    return f"{lake.rstrip('/')}/_ingest/ledger"


def claimed(spark: SparkSession, lake: str, table: str) -> set[int]:
    """All batch ids that somebody has claimed."""
    return {int(name) for name in names(spark, claims_path(lake, table)) if name.isdigit()}


def uncommitted(spark: SparkSession, lake: str, table: str) -> set[int]:
    """Batch ids that are claimed and not in the ledger: being written, or left by a crash."""
    done = {name.partition("=")[2] for name in names(spark, f"{ledger_path(lake)}/table={table}")}
    return {batch for batch in claimed(spark, lake, table) if str(batch) not in done}


def read_lake(spark: SparkSession, path: str, table: str, as_of_batch: int | None = None) -> DataFrame:
    """A lake table folder, committed batches only. Keeps ts_day (time filters prune by it) and
    the batch columns; ``as_of_batch`` reads the table as it was after that batch."""
    contract = schema.TABLES[table]
    full = T.StructType([
        *contract.fields, T.StructField("_source_file", T.StringType()),
        T.StructField("ts_day", T.DateType()), T.StructField("_batch_id", T.LongType())])
    lake = path.rstrip("/").rpartition("/")[0]
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in NO_FILES:
            return schema.empty(spark, full)
        raise
    unfinished = sorted(uncommitted(spark, lake, table))
    if unfinished:  # as many as there are writers and crashes
        rows = rows.filter(~F.col("_batch_id").isin(unfinished))
    if as_of_batch is not None:
        rows = rows.filter(F.col("_batch_id") <= as_of_batch)
    return rows


def read_catalog(spark: SparkSession, namespace: str, table: str, optional: bool = False) -> DataFrame:
    """A catalog table, with pushdown intact; an optional one may be missing."""
    name = f"{namespace}.{table}"
    if optional and not spark.catalog.tableExists(name):
        return schema.empty(spark, schema.TABLES[table])
    return schema.conform(spark.table(name), schema.TABLES[table], keep=schema.LAKE_COLUMNS)


def register(**frames: DataFrame) -> None:
    """Make frames available to SQL under their table names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def open_tables(spark: SparkSession, root: str = "", namespace: str | None = None,
                ingested: bool = False) -> dict[str, DataFrame]:
    """All contract tables, registered: raw chunk folders below ``root``, the
    folders of an ingested lake, or the tables of a catalog namespace."""
    frames = {}
    for table in ("vm_metrics", "app_events", "topology"):
        folder = f"{root.rstrip('/')}/{table}"
        if namespace:
            frames[table] = read_catalog(spark, namespace, table, optional=table == "topology")
        elif ingested and table in schema.FACTS:
            frames[table] = read_lake(spark, folder, table)
        else:
            frames[table] = read_chunks(spark, folder, table)
    register(**frames)
    return frames


def table_of(path: Column) -> Column:
    """The table a chunk belongs to, by its path; null when it is none of ours."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))

    def below(name: str) -> Column:
        return slashed.contains(f"{name}/") | slashed.startswith(name)

    return F.when(below("app_events"), "app_events").when(below("vm_metrics"), "vm_metrics")


def list_chunks(spark: SparkSession, root: str, table: str | None = None) -> DataFrame:
    """(file_path, table, length, modified) of every chunk below ``root``, or of
    one table's; the file contents are not read. Files of no known table are left
    out. Only the path below ``root`` decides the table."""
    root = root.rstrip("/")
    folder = f"{root}/{table}" if table else root
    if not names(spark, folder):
        return schema.empty(spark, T.StructType([
            T.StructField("file_path", T.StringType()), T.StructField("table", T.StringType()),
            T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType())]))
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet").load(folder))
    base = urlsplit(root).path or root
    found = F.locate(base, F.col("path"))
    key = F.when(found > 0, F.substr("path", found + F.lit(len(base) + 1))).otherwise(F.col("path"))
    return files.select(
        F.col("path").alias("file_path"), table_of(key).alias("table"),
        "length", F.col("modificationTime").alias("modified")).filter(F.col("table").isNotNull())
