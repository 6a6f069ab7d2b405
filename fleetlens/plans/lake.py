"""One handle on a lake: SQL, alerts, dependency traces and answers by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from fleetlens.config import Thresholds
from fleetlens.operators import graph
from fleetlens.operators.history import time_bounds
from fleetlens.operators.questions import APPS
from fleetlens.operators.windows import Bounds
from fleetlens.plans import answers, sqlguard
from fleetlens.plans.detect import detect, select_alerts
from fleetlens.sources.tables import open_tables, register
from fleetlens.streaming.ingest import read_ledger


@dataclass
class Lake:
    metrics: DataFrame
    topology: DataFrame
    cfg: Thresholds = field(default_factory=Thresholds)
    apps: Sequence[str] = tuple(APPS)
    #: Time bounds from the ingest ledger; without them they are read from the fact.
    bounds: Bounds | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str = "", cfg: Thresholds | None = None,
             namespace: str | None = None, ingested: bool = False) -> "Lake":
        frames = open_tables(spark, root, namespace, ingested)
        bounds = time_bounds(read_ledger(spark, root)) if ingested else None
        return cls(frames["vm_metrics"], frames["topology"], cfg or Thresholds(), bounds=bounds)

    def alerts(self, asof: float = 0.0) -> DataFrame:
        found = detect(self.metrics, self.cfg, asof, bounds=self.bounds)
        register(alerts=found)
        return found

    def run_sql(self, sql: str) -> sqlguard.SQLResult:
        return sqlguard.run(self.metrics.sparkSession, sql)

    def get_alerts(self, severity: str | None = None, app: str | None = None,
                   asof: float = 0.0) -> DataFrame:
        return select_alerts(self.alerts(asof), severity, app)

    def trace_dependencies(self, app: str, asof: float = 0.0) -> DataFrame:
        root = graph.roots_of(self.metrics.sparkSession, app)
        return graph.trace(self.topology, root, self.alerts(asof)).orderBy("direction", "depth", "app")

    def answer(self, question: str, asof: float = 0.0) -> DataFrame:
        """The answer to one question, as ordered lines."""
        asked = self.metrics.sparkSession.createDataFrame([(question,)], "question string")
        lines = answers.answer(asked, self.metrics, self.topology, self.cfg, self.apps, asof=asof)
        return lines.orderBy("line_no", "line").select("app", "intent", "line")

    def call(self, name: str, **arguments):
        """Run a tool by name. Errors come back as text, for a caller that can
        only read."""
        tools = {"run_sql": self.run_sql, "get_alerts": self.get_alerts,
                 "trace_dependencies": self.trace_dependencies, "answer": self.answer}
        if name not in tools:
            return f"unknown tool: {name}"
        try:
            return tools[name](**arguments)
        except Exception as error:
            return f"ERROR: {type(error).__name__}: {error}"
