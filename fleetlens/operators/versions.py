"""Versions of a dimension that is loaded as whole snapshots: each row with the span in which it was valid.

A load closes the rows it no longer has and opens the new ones; rows that stay are not touched. Reading
as of a load or an instant is a filter, and joins only the dimension, never the facts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

VALID = "valid_from timestamp, valid_to timestamp"


def first_versions(snapshot: DataFrame, at: datetime) -> DataFrame:
    """The rows of the first load."""
    return snapshot.distinct().withColumns({"valid_from": F.lit(at), "valid_to": F.lit(None).cast("timestamp")})


def merged(versions: DataFrame, snapshot: DataFrame, at: datetime) -> DataFrame:
    """The versions after another load. Null values of a row are compared as values. A load that is repeated
    changes nothing; loads come in the order of their time."""
    columns = [c for c in versions.columns if c not in ("valid_from", "valid_to")]
    past, now = versions.filter("valid_to IS NOT NULL"), versions.filter("valid_to IS NULL")
    key = F.struct(*columns)
    new = snapshot.select(*columns).distinct().select(F.to_json(key, {"ignoreNullFields": "false"}).alias("_row"), key.alias("_new"))
    old = now.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("_row"), key.alias("_old"), "valid_from")
    both = old.join(new, "_row", "full")
    row = F.coalesce("_old", "_new")
    current = both.select(
        row.alias("_r"), F.coalesce("valid_from", F.lit(at)).alias("valid_from"),
        F.when(F.col("_new").isNull(), F.lit(at)).cast("timestamp").alias("valid_to"))
    return past.unionByName(current.select("_r.*", "valid_from", "valid_to"))


def as_of(versions: DataFrame, at: datetime | Column) -> DataFrame:
    """The rows that were valid at an instant; a load holds from its own time on."""
    at = at if isinstance(at, Column) else F.lit(at)
    open_ = F.col("valid_to").isNull() | (F.col("valid_to") > at)
    return versions.filter((F.col("valid_from") <= at) & open_).drop("valid_from", "valid_to")


def changes(versions: DataFrame) -> DataFrame:
    """(at, opened, closed): how many rows each load opened and closed."""
    spans = F.array(F.struct(F.col("valid_from").alias("at"), F.lit(1).alias("opened"), F.lit(0).alias("closed")),
                    F.struct(F.col("valid_to").alias("at"), F.lit(0).alias("opened"), F.lit(1).alias("closed")))
    return (versions.select(F.inline(spans)).filter("at IS NOT NULL").groupBy("at")
            .agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed")))
