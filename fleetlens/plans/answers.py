"""Answers to routed questions, for a whole table of questions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.config import Thresholds
from fleetlens.functions.sizing import small_side
from fleetlens.operators import graph, rca
from fleetlens.operators.features import Frames, app_latency, frames
from fleetlens.operators.questions import APPS, BLAST_HINTS, route
from fleetlens.operators.windows import instants
from fleetlens.plans.detect import alerts_of

col, lit = F.col, F.lit


def default_app(metrics: DataFrame, cfg: Thresholds, asof: float = 0.0, found: Frames | None = None) -> str | None:
    """The slowest app of the recent window, which unnamed questions are about."""
    latency = found.app if found else app_latency(metrics, cfg, instants(metrics, cfg, asof))
    row = rca.slowest_app(latency).first()
    return row.app if row else None


def blast_lines(topology: DataFrame, roots: DataFrame, alerts: DataFrame) -> DataFrame:
    """(app, line_no, line): the dependency trace of every root, as text rows.

    A root without neighbours in a direction gets a "(none)" line there. Lines
    are numbered by direction, depth and name in steps, not consecutively.
    """
    traced = graph.trace(topology, roots, alerts).withColumnRenamed("root", "root_app")
    entry = traced.select(
        "root_app", (F.when(col("direction") == graph.DOWNSTREAM, 4).otherwise(6)).alias("block"), "depth",
        F.concat(lit("  depth "), col("depth").cast("string"), lit(": "), col("app"),
                 F.when(col("tags") != "", F.concat(lit("  ALERTS: "), col("tags"))).otherwise("")).alias("line"))
    counts = roots.select(col("root").alias("root_app")).join(
        traced.groupBy("root_app").agg(
            F.count_if(col("direction") == graph.DOWNSTREAM).alias("n_down"),
            F.count_if(col("direction") == graph.UPSTREAM).alias("n_up")), "root_app", "left")
    app = col("root_app")

    def block(number: int, text: Column) -> Column:
        return F.struct(lit(number).alias("block"), lit(0).alias("depth"), text.alias("line"))

    none = lit("  (none)")
    # The wording of the answer.
    fixed = counts.select("root_app", F.explode(F.array_compact(F.array(
        block(0, F.concat(lit("## Blast radius: "), app)),
        block(1, lit("")),
        block(2, F.concat(lit("app: "), app)),
        block(3, F.concat(lit("downstream (impacted if "), app, lit(" fails):"))),
        F.when(F.coalesce("n_down", lit(0)) == 0, block(4, none)),
        block(5, F.concat(lit("upstream ("), app, lit(" depends on):"))),
        F.when(F.coalesce("n_up", lit(0)) == 0, block(6, none)),
        block(7, lit("")),
        block(8, F.concat(
            lit("**Interpretation:** if "), app, lit(" degrades, every downstream app above "
            "loses its dependency; any already showing ALERTS is feeling it now. "
            "Trace the chain to connect a root-cause alert on "), app,
            lit(" to the user-facing symptoms upstream."))),
    ))).alias("x")).select("root_app", "x.*")
    return fixed.unionByName(entry).select(
        col("root_app").alias("app"), (col("block") * 1_000_000 + col("depth")).alias("line_no"), "line")


def answer_lines(metrics: DataFrame, topology: DataFrame, alerts: DataFrame, cfg: Thresholds,
                 apps: Sequence[str], asof: float = 0.0, found: Frames | None = None) -> DataFrame:
    """(app, intent, line_no, line): both kinds of answer for the listed apps."""
    spark = metrics.sparkSession
    judged = rca.verdict(rca.facts(metrics, cfg, alerts, asof, found, apps), cfg)
    causes = rca.narrative_lines(judged).filter(col("app").isin(list(apps)))
    blast = blast_lines(topology, graph.roots_of(spark, *apps), alerts)
    return (causes.withColumn("intent", lit("rca"))
            .unionByName(blast.withColumn("intent", lit("blast")))
            .select("app", "intent", "line_no", "line"))


def answer(questions: DataFrame, metrics: DataFrame, topology: DataFrame, cfg: Thresholds,
           apps: Sequence[str] = tuple(APPS), hints: Sequence[str] = tuple(BLAST_HINTS),
           asof: float = 0.0) -> DataFrame:
    """Every question with its app, its intent and the lines of its answer; none goes
    without one, also where there are no samples of its app.

    The fact is aggregated once, into feature frames; alerts, verdicts and the
    default app come from those. Answers are made once per (app, intent) and
    joined to the questions, so none of this depends on how many there are.
    """
    found = frames(metrics, cfg, instants(metrics, cfg, asof)).kept()
    alerts = alerts_of(found, cfg).drop("asof")
    fallback = default_app(metrics, cfg, asof, found) or next(iter(apps), None)
    routed = route(questions, fallback, apps, hints)
    known = list(dict.fromkeys([*apps, *([fallback] if fallback else [])]))
    lines = answer_lines(metrics, topology, alerts, cfg, known, asof, found)
    return routed.join(small_side(lines), ["app", "intent"], "left")
