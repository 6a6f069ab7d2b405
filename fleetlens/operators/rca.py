"""Root-cause facts and the verdict, for all apps in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.config import Thresholds
from fleetlens.functions.stats import hundredth, severity_rank, tenth, whole
from fleetlens.operators.features import Frames, frames
from fleetlens.operators.windows import instants

col = F.col


def slowest_app(latency: DataFrame) -> DataFrame:
    """The app with the highest recent p95 (one row, name breaks ties)."""
    return (latency.filter(col("p95_recent").isNotNull())
            .select("app", col("p95_recent").alias("p95"))
            .orderBy(F.desc("p95"), "app").limit(1))


def worst_vms(features: DataFrame, cfg: Thresholds) -> DataFrame:
    """The VMs of each app with the highest mean recent latency, ranked from 1.

    The rank filter is a per-partition top-k before the shuffle, so an app with
    many VMs sends only its best candidates.
    """
    rank = F.row_number().over(
        Window.partitionBy("app").orderBy(F.desc_nulls_last("latency_recent"), "vm_id"))
    return (features.filter((col("n_recent") > 0) & col("app").isNotNull())
            .withColumn("place", rank).filter(col("place") <= cfg.rca_worst_vms)
            .select("app", "place", "vm_id", col("heap_slope_recent").alias("heap_slope"),
                    col("heap_now_recent").alias("heap_now"), col("gc_recent").alias("gc"),
                    col("io_recent").alias("io_await"), col("latency_recent").alias("latency")))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Per app: alert counts by severity, the rules in order of first appearance,
    and whether a heap leak is among them."""
    rank = severity_rank(col("severity"))
    per_rule = alerts.groupBy("app", "severity", "rule").agg(F.count("*").alias("n"))
    by_severity = (per_rule.groupBy("app", "severity").agg(F.sum("n").alias("n"))
                   .groupBy("app").agg(F.sort_array(F.collect_list(
                       F.struct((-col("n")).alias("n"), rank.alias("rank"), "severity"))).alias("sev")))
    by_rule = (per_rule.groupBy("app", "rule").agg(F.min(rank).alias("rank"))
               .groupBy("app").agg(F.sort_array(F.collect_list(F.struct("rank", "rule"))).alias("rules"),
                                   F.bool_or(col("rule") == "heap_leak").alias("leaking")))
    counts = F.transform("sev", lambda s: F.concat((-s["n"]).cast("string"), F.lit("x "), s["severity"]))
    return by_severity.join(by_rule, "app").select(
        "app", F.array_join(counts, ", ").alias("alert_counts"),
        F.array_join(F.transform("rules", lambda r: r["rule"]), "; ").alias("alert_rules"), "leaking")


def facts(metrics: DataFrame, cfg: Thresholds, alerts: DataFrame, asof: float = 0.0,
          found: Frames | None = None, apps: Sequence[str] = ()) -> DataFrame:
    """One row per app: p95 now and baseline, its worst VMs, its alert summary.

    ``found``: the feature frames of this instant, where the caller has them.
    ``apps`` have a row whether there are samples of them or not.
    """
    points = instants(metrics, cfg, asof)
    found = found or frames(metrics, cfg, points)
    worst = worst_vms(found.vm, cfg).groupBy("app").agg(
        F.sort_array(F.collect_list(F.struct(
            "place", "vm_id", "heap_slope", "heap_now", "gc", "io_await", "latency"))).alias("worst"))
    latency = found.app.filter(col("app").isNotNull())
    if apps:
        listed = metrics.sparkSession.createDataFrame([(app,) for app in dict.fromkeys(apps)], "app string")
        latency = latency.join(listed, "app", "full")
    end = F.timestamp_micros(F.lit(points[0].end))
    return (latency
            .join(worst, "app", "left").join(alert_summary(alerts), "app", "left")
            .select("app", F.coalesce("t_end", end).alias("t_end"), F.coalesce("p95_recent", F.lit(0.0)).alias("p95_now"),
                    F.coalesce("p95_base", F.lit(0.0)).alias("p95_base"),
                    "worst", "alert_counts", "alert_rules",
                    F.coalesce("leaking", F.lit(False)).alias("leaking")))


def _worst(field: str) -> Column:
    return F.get("worst", F.lit(0))[field]


def verdict(found: DataFrame, cfg: Thresholds) -> DataFrame:
    """Flags and cause per app, beside the numbers they rest on."""
    slope, heap = _worst("heap_slope"), _worst("heap_now")
    heap_clause = (slope > cfg.rca_heap_slope) & (heap > cfg.heap_cap_mb * cfg.rca_heap_fill)
    io_clause = _worst("io_await") > cfg.rca_io_ms
    return found.select(
        "*",
        ((col("p95_base") > 0) & (col("p95_now") > col("p95_base") * cfg.rca_latency_x)).alias("elevated"),
        F.try_divide("p95_now", "p95_base").alias("factor"),
        _worst("vm_id").alias("worst_vm"), _worst("latency").alias("worst_latency"),
        F.coalesce(heap_clause, F.lit(False)).alias("heap_climbing"),
        F.when(heap_clause, F.try_divide(F.lit(cfg.heap_cap_mb) - heap, slope)).alias("heap_eta"),
        F.coalesce(_worst("gc") > cfg.rca_gc_ms, F.lit(False)).alias("gc_high"),
        F.coalesce(io_clause, F.lit(False)).alias("io_high"),
        F.when(col("leaking"), "heap_leak").when(io_clause, "io_saturation").otherwise("none").alias("cause"))


# Wording of the conclusion.
CONCLUSION = {
    "heap_leak": "**Likely cause:** a JVM heap leak driving GC pressure and "
                 "latency toward an OOM. **Action:** capture a heap dump and schedule "
                 "a rolling restart before the ETA.",
    "io_saturation": "**Likely cause:** downstream disk/IO saturation. **Action:** "
                     "check the storage backend and slow queries.",
}


def narrative_lines(judged: DataFrame) -> DataFrame:
    """(app, line_no, line): the root-cause summary of every app."""
    lit = F.lit
    latency = F.when(
        col("elevated"),
        F.concat(lit("- **Latency is elevated**: p95 "), whole(col("p95_now")), lit(" ms vs baseline "),
                 whole(col("p95_base")), lit(" ms ("), tenth(col("factor")), lit("x).")),
    ).otherwise(
        F.concat(lit("- Latency p95 is "), whole(col("p95_now")), lit(" ms (baseline "),
                 whole(col("p95_base")), lit(" ms) — near normal.")))
    detail = F.concat_ws(
        "; ",
        F.when(col("heap_climbing"), F.concat(
            lit("heap climbing +"), whole(_worst("heap_slope")), lit(" MB/min (now "),
            whole(_worst("heap_now")), lit(" MB, OOM ETA ~"), whole(col("heap_eta")), lit(" min)"))),
        F.when(col("gc_high"), F.concat(lit("GC pauses ~"), whole(_worst("gc")), lit(" ms"))),
        F.when(col("io_high"), F.concat(lit("disk await ~"), whole(_worst("io_await")), lit(" ms"))))
    worst = F.when(col("worst_vm").isNotNull(), F.concat(
        lit("- **Worst VM "), col("worst_vm"), lit("**: latency ~"),
        F.coalesce(whole(col("worst_latency")), lit("nan")), lit(" ms — "),
        F.when(detail == "", "no single dominant metric").otherwise(detail), lit(".")))
    active = F.when(
        col("alert_rules").isNotNull(),
        F.concat(lit("- **Active alerts**: "), col("alert_counts"), lit(" — "), col("alert_rules")),
    ).otherwise(lit("- No active alerts for this app."))
    conclusion = F.when(col("cause") == "heap_leak", lit(CONCLUSION["heap_leak"])).when(
        col("cause") == "io_saturation", lit(CONCLUSION["io_saturation"]))
    lines = F.array_compact(F.array(
        F.concat(lit("## "), col("app"), lit(": root-cause summary (as of "),
                 F.date_format("t_end", "HH:mm:ss"), lit(")")),
        lit(""), latency, worst, active,
        F.when(conclusion.isNotNull(), lit("")), conclusion))
    return judged.select("app", F.posexplode(lines).alias("line_no", "line"))


def narrative(judged: DataFrame) -> DataFrame:
    """(app, text): the same lines as one text; an app has at most seven."""
    return (narrative_lines(judged).groupBy("app")
            .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
            .select("app", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")))


def facts_lines(found: DataFrame, alerts: DataFrame) -> DataFrame:
    """(app, section, line_no, line): the facts as text rows, alerts included."""
    lit = F.lit
    head = found.select("app", F.posexplode(F.array(
        F.concat(lit("app: "), col("app")),
        F.concat(lit("app_latency_ms p95: now="), whole(col("p95_now")), lit(" ms, baseline="),
                 whole(col("p95_base")), lit(" ms")))).alias("line_no", "line"))
    numbers = [F.concat(lit(f" {name}="), F.coalesce(form(col(f"w.{name}")), lit("nan"))) for name, form in (
        ("heap_slope", hundredth), ("heap_now", tenth), ("gc", tenth), ("io_await", tenth), ("latency", tenth))]
    vms = found.select("app", F.posexplode("worst").alias("line_no", "w")).select(
        "app", "line_no", F.concat(col("w.vm_id"), *numbers).alias("line"))
    active = alerts.filter(col("app") != "").select(
        "app", (severity_rank(col("severity"))).cast("int").alias("line_no"),
        F.concat_ws(" ", "severity", "rule", "vm_id", "headline").alias("line"))
    out = head.withColumn("section", lit("latency"))
    for section, part in (("worst_vms", vms), ("alerts", active)):
        out = out.unionByName(part.withColumn("section", lit(section)))
    return out.select("app", "section", "line_no", "line")
