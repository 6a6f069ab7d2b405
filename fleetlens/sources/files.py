"""Small marker files in the lake, through the file system that the lake is on."""

from __future__ import annotations

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    system, where = _at(spark, folder)
    return [status.getPath().getName() for status in system.listStatus(where)] if system.exists(where) else []


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if there is one of that name already."""
    system, where = _at(spark, path)
    if system.exists(where):
        return False
    try:
        stream = system.create(where, False)  # fails if another writer was faster
    except PySparkException:
        return False
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a marker file; None if there is none."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
