"""Incremental ingest: every raw chunk lands in the lake exactly once.

A lake table is Parquet partitioned by (ts_day, _batch_id). Whoever loads a batch
first claims an id for it: a marker file that only one writer can create names the
owner, a stream and its batch. Ids are never shared or used again, so no batch can
overwrite another, and a batch that is repeated after a crash finds its claim and
replaces what it had written. Then its files are recorded in the ledger, which is also
the batch history. Readers leave out ids that are claimed and not in the ledger.

Two ways in, sharing claim and commit: ``ingest_stream`` (file stream and checkpoint)
and ``ingest_files`` (listing minus ledger, for one-off loads and empty chunks).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens import schema
from fleetlens.functions.sizing import small_side
from fleetlens.session import checkpoint as checkpoint_rows
from fleetlens.sources.files import create, names, read
from fleetlens.sources.tables import (NO_FILES, claimed, claims_path, ledger_path, list_chunks, raw_schema, read_lake,
                                      uncommitted)

LEDGER = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("first_ts", T.TimestampType()), T.StructField("last_ts", T.TimestampType()),
    T.StructField("stream", T.StringType()), T.StructField("stream_batch", T.LongType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("table", T.StringType()), T.StructField("batch_id", T.LongType())])
BY_HAND = "files"          # stream name of batches loaded without a stream, before a digest of their files
MAX_FILES = 1000
# How landed files are laid out for reads of single VMs.
SKIPPING = {"parquet.block.size": str(16 << 20), "parquet.bloom.filter.enabled#vm_id": "true",
            "parquet.bloom.filter.expected.ndv#vm_id": "10000"}


def table_path(lake: str, table: str) -> str:
    return f"{lake.rstrip('/')}/{table}"


def read_ledger(spark: SparkSession, lake: str) -> DataFrame:
    if not names(spark, ledger_path(lake)):
        return schema.empty(spark, LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger_path(lake))


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**SKIPPING)
     .partitionBy(*partitions).parquet(path))


def partials_path(lake: str) -> str:
    return f"{lake.rstrip('/')}/_ingest/partials"


def vm_partials(counted: DataFrame) -> DataFrame:
    """(vm_id, app, n_samples, first_ts, last_ts) of a batch, or of several put together."""
    n = "rows" if "rows" in counted.columns else "n_samples"
    return counted.groupBy("vm_id", "app").agg(F.sum(n).alias("n_samples"), F.min("first_ts").alias("first_ts"),
                                               F.max("last_ts").alias("last_ts"))


def read_partials(spark: SparkSession, lake: str, table: str = "vm_metrics", as_of_batch: int | None = None) -> DataFrame:
    """VMs and apps of a lake table with their sample counts, from what each committed batch added; the table is not read."""
    known = "vm_id string, app string, n_samples long, first_ts timestamp, last_ts timestamp, table string, batch_id long"
    if not names(spark, partials_path(lake)):
        return vm_partials(spark.createDataFrame([], known))
    rows = spark.read.schema(known).parquet(partials_path(lake)).filter(F.col("table") == table)
    unfinished = sorted(uncommitted(spark, lake, table))
    if unfinished:
        rows = rows.filter(~F.col("batch_id").isin(unfinished))
    if as_of_batch is not None:
        rows = rows.filter(F.col("batch_id") <= as_of_batch)
    return vm_partials(rows)


def read_as_of(spark: SparkSession, lake: str, table: str, at: datetime) -> DataFrame:
    """A lake table as it was at an instant: the batches that had been committed by then, whatever their order."""
    done = (read_ledger(spark, lake).filter((F.col("table") == table) & (F.col("ingested_at") <= F.lit(at)))
            .select(F.col("batch_id").alias("_batch_id")).distinct())
    return read_lake(spark, table_path(lake, table), table).join(small_side(done), "_batch_id", "left_semi")


def claim(spark: SparkSession, lake: str, table: str, stream: str, stream_batch: int) -> int:
    """The lake batch id of a stream's batch: the one it has, or the next free one."""
    owner = f"{stream} {stream_batch}"
    own = (read_ledger(spark, lake).filter((F.col("table") == table) & (F.col("stream") == stream)
                                           & (F.col("stream_batch") == stream_batch))
           .agg(F.min("batch_id")).first()[0])
    if own is not None:
        return own
    folder = claims_path(lake, table)
    for batch_id in sorted(uncommitted(spark, lake, table)):
        if read(spark, f"{folder}/{batch_id}") == owner:
            return batch_id
    last = read_ledger(spark, lake).filter(F.col("table") == table).agg(F.max("batch_id")).first()[0]
    batch_id = max([-1 if last is None else last, *claimed(spark, lake, table)]) + 1
    while not create(spark, f"{folder}/{batch_id}", owner):
        batch_id += 1
    return batch_id


def _landed(spark: SparkSession, lake: str, table: str, batch_id: int) -> DataFrame:
    """What a batch has written, from its own folders alone."""
    full = T.StructType([*schema.TABLES[table].fields, T.StructField("_source_file", T.StringType())])
    path = table_path(lake, table)
    try:
        return spark.read.schema(full).parquet(f"{path}/ts_day=*/_batch_id={batch_id}")
    except AnalysisException as error:
        if error.getCondition() in NO_FILES:
            return schema.empty(spark, full)
        raise


def commit(spark: SparkSession, lake: str, table: str, rows: DataFrame, stream: str, stream_batch: int,
           read_files: DataFrame | None = None) -> int:
    """Write one batch and then its ledger rows; safe to repeat. Returns its id.

    ``rows`` has the raw columns and ``_source_file``. There is no shuffle: each
    task writes the chunks it read. ``read_files`` names the chunks of the batch
    where they are known, so that empty ones are recorded with 0 rows.
    """
    batch_id = claim(spark, lake, table, stream, stream_batch)
    landed = schema.conform(rows, schema.TABLES[table], keep=["_source_file"]).withColumns({
        "ts_day": F.to_date("ts"), "_batch_id": F.lit(batch_id).cast("long")})
    # By VM inside a day: row groups, pages and bloom filters then tell which of them a VM is in.
    _replace(landed.sortWithinPartitions("ts_day", "_batch_id", "vm_id", "ts"), table_path(lake, table), "ts_day", "_batch_id")
    counted = checkpoint_rows(_landed(spark, lake, table, batch_id).groupBy(F.col("_source_file").alias("file_path"), "vm_id", "app")
                              .agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    _replace(vm_partials(counted).withColumns({"table": F.lit(table), "batch_id": F.lit(batch_id).cast("long")}),
             partials_path(lake), "table", "batch_id")
    written = counted.groupBy("file_path").agg(F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"),
                                               F.max("last_ts").alias("last_ts"))
    if read_files is not None:
        written = read_files.select("file_path").join(written, "file_path", "left")
    _replace(written.select(
        "file_path", F.coalesce("rows", F.lit(0)).alias("rows"), "first_ts", "last_ts",
        F.lit(stream).alias("stream"),
        F.lit(stream_batch).cast("long").alias("stream_batch"),
        F.current_timestamp().alias("ingested_at"), F.lit(table).alias("table"),
        F.lit(batch_id).cast("long").alias("batch_id")), ledger_path(lake), "table", "batch_id")
    return batch_id


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that owns a checkpoint folder; it goes when the folder goes."""
    marker = f"{checkpoint}/_stream_name"
    create(spark, marker, uuid.uuid4().hex)
    return read(spark, marker)


def ingest_stream(spark: SparkSession, raw: str, lake: str, table: str, watch_seconds: float | None = None,
                  max_files: int = MAX_FILES, on_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start the ingest of one table and return its query.

    Processes what is there and stops, or polls every ``watch_seconds``. With
    ``max_files=1`` every chunk is a batch of its own. A chunk is known by its
    path: one that is rewritten under the same name is not read again. The folder
    of the table may still be missing.
    """
    checkpoint = f"{lake.rstrip('/')}/_ingest/checkpoint/{table}"
    # As a pattern, the folder need not exist yet.
    source = table_path(raw, f"{{{table}}}")
    chunks = (spark.readStream.schema(raw_schema(spark, [table_path(raw, table)], schema.FACTS[table]))
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
              .option("maxFilesPerTrigger", max_files).parquet(source)
              .select("*", F.col("_metadata.file_path").alias("_source_file")))
    name = _stream_name(spark, checkpoint)

    def land(batch: DataFrame, stream_batch: int) -> None:
        session = batch.sparkSession
        # Chunks that came in another way: by hand, or under a checkpoint that was lost.
        done = read_ledger(session, lake).filter(
            (F.col("table") == table) & ~((F.col("stream") == name) & (F.col("stream_batch") == stream_batch)))
        again = batch.select("_source_file").distinct().join(
            done.select(F.col("file_path").alias("_source_file")), "_source_file", "left_semi")
        if not again.isEmpty():
            batch = batch.join(small_side(again), "_source_file", "left_anti")
        batch_id = commit(session, lake, table, batch, name, stream_batch)
        if on_commit:
            on_commit(batch_id)

    writer = chunks.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    if watch_seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{watch_seconds} seconds").start()


def ingest_files(spark: SparkSession, raw: str, lake: str, table: str, max_files: int = MAX_FILES) -> int:
    """Load the chunks the ledger does not have, ``max_files`` per batch; returns
    the number of batches. Empty chunks are recorded and add nothing."""
    ledger = read_ledger(spark, lake).filter(F.col("table") == table)
    todo = checkpoint_rows(list_chunks(spark, raw, table).filter(F.col("table") == table)
                           .join(ledger, "file_path", "left_anti").select("file_path"))
    batches, last = 0, ""
    while True:
        # Spark plans a read from a list of names: this many at a time.
        page = todo.filter(F.col("file_path") > last).orderBy("file_path").limit(max_files)
        paths = [row.file_path for row in page.collect()]
        if not paths:
            return batches
        rows = (spark.read.schema(raw_schema(spark, paths, schema.FACTS[table])).parquet(*paths)
                .select("*", F.col("_metadata.file_path").alias("_source_file")))
        listed = spark.createDataFrame([(path,) for path in paths], "file_path string")
        # The paths say which batch this is, so repeating it after a crash finds its claim.
        commit(spark, lake, table, rows, f"{BY_HAND}:{md5(chr(10).join(paths).encode()).hexdigest()}", 0, listed)
        batches, last = batches + 1, paths[-1]


def ingest_once(spark: SparkSession, raw: str, lake: str, max_files: int = MAX_FILES) -> DataFrame:
    """Ingest all new chunks of both fact tables through the streams, then record
    empty chunks; returns the ledger rows that this pass added."""
    before = checkpoint_rows(read_ledger(spark, lake).select("table", "batch_id").distinct())
    for table in schema.FACTS:
        ingest_stream(spark, raw, lake, table, max_files=max_files).awaitTermination()
        ingest_files(spark, raw, lake, table, max_files)
    return (read_ledger(spark, lake).join(small_side(before), ["table", "batch_id"], "left_anti")
            .select("file_path", "table", "rows", "batch_id"))
