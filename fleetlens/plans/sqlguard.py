"""Read-only SQL over the registered tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Words a read-only statement may not contain. The test is textual:
# a literal that contains one of them is refused as well.
FORBIDDEN_WORDS = [
    "insert", "update", "delete", "drop", "create", "alter", "attach", "copy",
    "pragma", "install", "load", "export", "call", "set", "vacuum", "analyze",
]
# Functions that run code of the JVM.
FORBIDDEN_FUNCTIONS = ["reflect", "java_method", "try_reflect"]
_FORBIDDEN = re.compile(r"\b(?:" + "|".join(FORBIDDEN_WORDS) + r")\b|\b(?:" + "|".join(FORBIDDEN_FUNCTIONS) + r")\b`?\s*\(",
                        re.IGNORECASE)
# What a printed result shows; the result itself is whole.
SHOWN_ROWS = 50


class ReadOnlySQLError(ValueError):
    pass


@dataclass
class SQLResult:
    rows: DataFrame              # the whole result
    shown: int = SHOWN_ROWS

    def text(self) -> str:
        """The first rows, and how many there are in all."""
        total = self.rows.count()
        body = self.rows.limit(self.shown).toPandas().to_string(index=False)
        note = f"\n... ({total} rows, showing {self.shown})" if total > self.shown else ""
        return f"rows: {total}\n{body}{note}"


# The statement, without blanks around it and the semicolons that close it.
_STATEMENT = re.compile(r"\s*(?P<body>.*?)\s*;*\s*", re.DOTALL)
_READ_ONLY = re.compile(r"select|with", re.IGNORECASE)


# A relation by several names in Spark's parsed plan, such as text.`/some/file`.
_RELATION = re.compile(r"'UnresolvedRelation \[([^\]]*)\]")


def check(sql: str) -> str:
    """The bare statement, or an error saying why it is refused."""
    body = _STATEMENT.fullmatch(sql)["body"]
    if ";" in body:
        raise ReadOnlySQLError("one statement per call")
    if not _READ_ONLY.match(body):
        raise ReadOnlySQLError("a query begins with SELECT or WITH")
    if _FORBIDDEN.search(body):
        raise ReadOnlySQLError("words that write, define or run code are refused")
    return body


def guarded(spark: SparkSession, sql: str) -> DataFrame:
    """The whole result of an accepted statement, lazily.

    Relations are taken from the plan that Spark parses, whatever their spelling:
    one with several names must be a catalog table, so files cannot be read by path.
    """
    body = check(sql)
    plan = spark.sql(f"EXPLAIN EXTENDED {body}").first()[0].partition("== Analyzed Logical Plan ==")[0]
    for found in _RELATION.findall(plan):
        parts = [part.strip() for part in found.split(",")]
        if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{part}`" for part in parts)):
            raise ReadOnlySQLError(f"not a registered table: {'.'.join(parts)}")
    return spark.sql(body)


def run(spark: SparkSession, sql: str, shown: int = SHOWN_ROWS) -> SQLResult:
    return SQLResult(guarded(spark, sql), shown)
