"""Null-proof join and grouping keys.

A null-safe equality makes Spark join on rewritten expressions, so a side that
is already partitioned on the raw column is shuffled again. Two plain non-null
columns per key avoid that and still keep null a group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def key_names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))] + [f"_z{i}" for i in range(len(keys))]


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    added = {}
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        filler = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
        added[f"_k{i}"] = F.coalesce(F.col(key), filler)
        added[f"_z{i}"] = F.col(key).isNull()
    return df.withColumns(added)
