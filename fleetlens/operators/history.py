"""Batch history of the lake, read from the ingest ledger alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.operators.windows import Bounds

LAST = 10


def batches(ledger: DataFrame) -> DataFrame:
    """(table, batch_id, added, n_files, committed_at): one row per batch that
    added rows; batches of empty chunks only are not snapshots."""
    return (ledger.groupBy("table", "batch_id")
            .agg(F.sum("rows").alias("added"), F.count("*").alias("n_files"),
                 F.min("ingested_at").alias("committed_at"))
            .filter(F.col("added") > 0))


def table_sizes(ledger: DataFrame) -> DataFrame:
    """(table, n_rows, n_batches)."""
    return batches(ledger).groupBy("table").agg(
        F.sum("added").alias("n_rows"), F.count("*").alias("n_batches"))


def time_bounds(ledger: DataFrame, table: str = "vm_metrics") -> Bounds | None:
    """Time bounds and row count of a table, without reading the table."""
    row = ledger.filter(F.col("table") == table).agg(
        F.unix_micros(F.min("first_ts")).alias("lo"), F.unix_micros(F.max("last_ts")).alias("hi"),
        F.sum("rows").alias("n")).first()
    return None if row.hi is None else Bounds(row.lo, row.hi, row.n)


def last_batches(ledger: DataFrame, last: int = LAST) -> DataFrame:
    """The last batches of each table with the row total before and after each.

    Only these rows meet in a window: the total before the oldest of them is the
    table's size less what they added, so a long history is never sorted.
    """
    all_batches = batches(ledger)
    place = F.row_number().over(Window.partitionBy("table").orderBy(F.desc("batch_id")))
    recent = all_batches.withColumn("_place", place).filter(F.col("_place") <= last).drop("_place")
    order = Window.partitionBy("table").orderBy("batch_id")
    whole = Window.partitionBy("table")
    added = F.sum("added").over(order)
    return (recent.join(table_sizes(ledger), "table")
            .withColumn("total", F.col("n_rows") - F.sum("added").over(whole) + added)
            .withColumn("previous_total", F.col("total") - F.col("added"))
            .select("table", "batch_id", "committed_at", F.lit("append").alias("operation"),
                    "n_files", "added", "previous_total", "total"))
