"""The detection rules, as expressions over a feature frame.

A rule is a predicate, a severity and evidence columns; adding one means adding
an entry to RULES (or passing a wider dict). All rules of a frame are evaluated
in one projection, so five rules cost one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.config import Thresholds
from fleetlens.functions.stats import severity_rank, tenth, whole

col = F.col


@dataclass(frozen=True)
class Rule:
    name: str
    scope: str                                            # "vm" or "app" feature frame
    fires: Callable[[Thresholds], Column]
    severity: Callable[[Thresholds], Column]
    evidence: Callable[[Thresholds], dict[str, Column]]   # unrounded
    digits: dict[str, int]                                # decimals in the alert text
    headline: Callable[[Thresholds], Column]
    action: str
    app: str = "app"                                      # column that holds the app


def _id(name: str) -> Column:
    """An id as alerts show it: a missing one is empty."""
    return F.coalesce(col(name), F.lit(""))


def _eta(cfg: Thresholds) -> Column:
    return F.try_divide(F.lit(cfg.heap_cap_mb) - col("heap_now"), col("heap_slope"))


def _io_z() -> Column:
    return F.try_divide(col("io_recent") - col("io_base"), col("io_base_std"))


def _factor() -> Column:
    return F.try_divide(col("p95_recent"), col("p95_base"))


def _err_floor(cfg: Thresholds) -> Column:
    return F.greatest(col("err_base"), F.lit(cfg.error_base_floor_pct))


def _both() -> Column:
    """A VM must be present on both sides of a recent-versus-baseline comparison;
    a row without an id has nothing to be compared by."""
    return (col("n_recent") > 0) & (col("n_base") > 0) & col("vm_id").isNotNull()


# Headlines and actions are fixed values: the texts of the alerts.
RULES: dict[str, Rule] = {rule.name: rule for rule in [
    Rule(
        name="heap_leak", scope="vm", app="app_heap",
        fires=lambda c: (
            (col("n_heap") >= c.heap_min_rows) & (col("heap_slope") > c.heap_min_slope)
            & (col("heap_corr") > c.heap_min_corr)
            & (col("heap_now") > c.heap_cap_mb * c.heap_min_fill)
            & (_eta(c) <= c.heap_horizon_min)),
        severity=lambda c: F.when(_eta(c) <= c.heap_p1_eta_min, "P1").otherwise("P2"),
        evidence=lambda c: {
            "corr": col("heap_corr"), "cur_heap_mb": col("heap_now"),
            "heap_cap_mb": F.lit(float(c.heap_cap_mb)), "oom_eta_min": _eta(c),
            "slope_mb_min": col("heap_slope")},
        digits={"corr": 3, "cur_heap_mb": 1, "oom_eta_min": 1, "slope_mb_min": 2},
        headline=lambda c: F.concat(
            F.lit("Heap leak on "), _id("vm_id"), F.lit(": +"), whole(col("heap_slope")),
            F.lit(" MB/min, OOM ETA ~"), whole(_eta(c)), F.lit(" min")),
        action="Capture heap dump; schedule rolling restart before ETA; "
               "check for unbounded cache/collection growth."),
    Rule(
        name="io_spike", scope="vm", app="app_recent",
        fires=lambda c: _both() & (col("io_base_std") > c.io_min_std) & (_io_z() > c.io_z),
        severity=lambda c: F.lit("P2"),
        evidence=lambda c: {
            "await_ms": col("io_recent"), "baseline_ms": col("io_base"),
            "cur_iops": col("iops_now"), "z": _io_z()},
        digits={"await_ms": 1, "baseline_ms": 1, "cur_iops": 0, "z": 2},
        headline=lambda c: F.concat(
            F.lit("Disk IO saturation on "), _id("vm_id"), F.lit(": await "),
            whole(col("io_recent")), F.lit("ms (z="), tenth(_io_z()), F.lit(")")),
        action="Check storage backend / noisy neighbor; inspect slow queries "
               "and disk queue depth."),
    Rule(
        name="net_retrans", scope="vm", app="app_recent",
        fires=lambda c: col("retrans_recent") > c.retrans_pct,
        severity=lambda c: F.lit("P2"),
        evidence=lambda c: {
            "retrans_pct": col("retrans_recent"), "threshold_pct": F.lit(float(c.retrans_pct))},
        digits={"retrans_pct": 2},
        headline=lambda c: F.concat(
            F.lit("Network retransmits on "), _id("vm_id"), F.lit(": "),
            tenth(col("retrans_recent")), F.lit("% (> "), whole(F.lit(float(c.retrans_pct))), F.lit("%)")),
        action="Check NIC/switch path, packet loss, and replication links; "
               "look for conn_reset events."),
    Rule(
        name="apm_latency", scope="app",
        fires=lambda c: (col("app").isNotNull() & (col("p95_recent") > col("p95_base") * c.latency_x)
                         & (col("p95_recent") > c.latency_floor_ms)),
        severity=lambda c: F.lit("P2"),
        evidence=lambda c: {
            "baseline_p95_ms": col("p95_base"), "factor_x": _factor(), "p95_ms": col("p95_recent")},
        digits={"baseline_p95_ms": 1, "factor_x": 2, "p95_ms": 1},
        headline=lambda c: F.concat(
            F.lit("Latency regression on "), _id("app"), F.lit(": p95 "), whole(col("p95_recent")),
            F.lit("ms (>"), whole(F.lit(float(c.latency_x))), F.lit("x baseline "),
            whole(col("p95_base")), F.lit("ms)")),
        action="Correlate with downstream dependency alerts (DB/IO); check "
               "recent deploys and GC pauses."),
    Rule(
        name="error_storm", scope="vm", app="app_recent",
        fires=lambda c: (_both() & (col("err_recent") > c.error_floor_pct)
                         & (col("err_recent") > _err_floor(c) * c.error_jump_x)),
        severity=lambda c: F.when(col("err_recent") > c.error_p1_pct, "P1").otherwise("P2"),
        evidence=lambda c: {
            "baseline_pct": col("err_base"), "error_rate_pct": col("err_recent"),
            "jump_x": F.try_divide(col("err_recent"), _err_floor(c))},
        digits={"baseline_pct": 2, "error_rate_pct": 2, "jump_x": 1},
        headline=lambda c: F.concat(
            F.lit("Error storm on "), _id("vm_id"), F.lit(": "), tenth(col("err_recent")),
            F.lit("% errors ("), whole(F.try_divide(col("err_recent"), _err_floor(c))),
            F.lit("x baseline)")),
        action="Check 5xx sources and upstream dependencies; consider "
               "circuit-breaking / rollback."),
]}


def rule_hits(features: DataFrame, rule: Rule, cfg: Thresholds) -> DataFrame:
    """Rows where one rule fires, with typed and unrounded evidence."""
    vm = _id("vm_id") if rule.scope == "vm" else F.lit("")
    return features.filter(rule.fires(cfg)).select(
        "asof", "t_end", rule.severity(cfg).alias("severity"), F.lit(rule.name).alias("rule"),
        vm.alias("vm_id"), _id(rule.app).alias("app"),
        *[value.alias(name) for name, value in rule.evidence(cfg).items()])


def _alert(rule: Rule, cfg: Thresholds) -> Column:
    vm = _id("vm_id") if rule.scope == "vm" else F.lit("")
    # Evidence keys are written in alphabetical order.
    evidence = F.struct(*[
        (F.bround(value, rule.digits[name]) if name in rule.digits else value).alias(name)
        for name, value in sorted(rule.evidence(cfg).items())])
    return F.struct(
        rule.severity(cfg).alias("severity"), F.lit(rule.name).alias("rule"),
        vm.alias("vm_id"), _id(rule.app).alias("app"),
        rule.headline(cfg).alias("headline"),
        F.to_json(evidence).alias("evidence_json"),
        F.lit(rule.action).alias("action"))


def alerts_from(features: DataFrame, cfg: Thresholds, rules: list[Rule]) -> DataFrame:
    """All alerts of one feature frame, in one pass over it."""
    fired = F.array(*[F.when(rule.fires(cfg), _alert(rule, cfg)) for rule in rules])
    return (features.select("asof", F.col("t_end").alias("ts"), F.explode(fired).alias("_a"))
            .filter(col("_a").isNotNull()).select("asof", "ts", "_a.*"))


def sort_alerts(alerts: DataFrame) -> DataFrame:
    """Severity first, then rule, then VM (then app, for app-level alerts)."""
    lead = ["asof"] if "asof" in alerts.columns else []
    return alerts.orderBy(*lead, severity_rank(col("severity")), "rule", "vm_id", "app")
