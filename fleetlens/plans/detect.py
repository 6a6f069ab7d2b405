"""Detection: all rules, at one or many instants, in one job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.config import Thresholds
from fleetlens.operators.features import Frames, app_latency, frames, vm_features
from fleetlens.operators.panes import sweep_features, sweep_latency
from fleetlens.operators.rules import RULES, Rule, alerts_from, rule_hits, sort_alerts
from fleetlens.operators.windows import Bounds, instants
from fleetlens.schema import ALERTS

REPLAY = (45.0, 30.0, 15.0, 0.0)


def replay(metrics: DataFrame, cfg: Thresholds, asofs: Sequence[float] = REPLAY,
           rules: dict[str, Rule] | None = None, fleet: DataFrame | None = None,
           bounds: Bounds | None = None) -> DataFrame:
    """Alerts at every instant, with the instant in ``asof``. Unsorted.

    ``fleet`` (vm_id, app) and ``bounds`` each save a scan
    where the caller has them.
    """
    return alerts_of(frames(metrics, cfg, instants(metrics, cfg, list(asofs), bounds), fleet), cfg, rules)


def sweep(metrics: DataFrame, cfg: Thresholds, asofs: Sequence[float], rules: dict[str, Rule] | None = None,
          bounds: Bounds | None = None) -> DataFrame:
    """The alerts that ``replay`` gives, for hundreds of instants. Unsorted.

    Samples are added up by panes once, and each instant's windows are merged from panes, so scans and shuffles do
    not grow with the number of instants. Best where the instants lie on a regular grid: panes are as long as the largest
    step that divides all distances.
    """
    points = instants(metrics, cfg, list(asofs), bounds)
    return alerts_of(Frames(sweep_features(metrics, cfg, points), sweep_latency(metrics, cfg, points)), cfg, rules)


def alerts_of(found: Frames, cfg: Thresholds, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Alerts of given feature frames, with ``asof``. Unsorted."""
    rules = RULES if rules is None else rules
    parts = []
    for scope, frame in (("vm", found.vm), ("app", found.app)):
        chosen = [rule for rule in rules.values() if rule.scope == scope]
        if chosen:
            parts.append(alerts_from(frame, cfg, chosen))
    return reduce(DataFrame.unionByName, parts)


def detect(metrics: DataFrame, cfg: Thresholds, asof: float = 0.0,
           rules: dict[str, Rule] | None = None, fleet: DataFrame | None = None,
           bounds: Bounds | None = None, ordered: bool = True) -> DataFrame:
    """The alerts table as of (data end - ``asof``), in contract order and sorted.

    ``ordered=False`` saves the sort where the alerts feed another query.
    """
    found = replay(metrics, cfg, [asof], rules, fleet, bounds).select(*ALERTS.names)
    return sort_alerts(found) if ordered else found


def hits(metrics: DataFrame, cfg: Thresholds, rule: str, asofs: Sequence[float] = (0.0,)) -> DataFrame:
    """Where one rule fires, with its unrounded evidence."""
    chosen = RULES[rule]
    points = instants(metrics, cfg, list(asofs))
    frame = (app_latency if chosen.scope == "app" else vm_features)(metrics, cfg, points)
    return rule_hits(frame, chosen, cfg)


def select_alerts(alerts: DataFrame, severity: str | None = None, app: str | None = None) -> DataFrame:
    """Alerts of a severity (any case) and/or an app, in the short column list."""
    if severity:
        alerts = alerts.filter(F.col("severity") == severity.upper())
    if app:
        alerts = alerts.filter(F.col("app") == app)
    return alerts.select("severity", "rule", "vm_id", "app", "headline")


def eta_timeline(metrics: DataFrame, cfg: Thresholds, asofs: Sequence[float] = REPLAY) -> DataFrame:
    """Heap-leak severity and ETA per VM over the replay, oldest instant first,
    with the change against the previous instant that alerted."""
    found = hits(metrics, cfg, "heap_leak", asofs)
    order = Window.partitionBy("vm_id").orderBy(F.desc("asof"))   # at most one row per instant
    return found.select(
        "asof", "t_end", "vm_id", "app", "severity", "oom_eta_min",
        (F.col("oom_eta_min") - F.lag("oom_eta_min").over(order)).alias("eta_change"))


def rule_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per instant, rule and severity."""
    return alerts.groupBy("asof", "rule", "severity").agg(F.count("*").alias("n_alerts"))
