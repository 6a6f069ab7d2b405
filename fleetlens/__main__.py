"""Command line: python -m fleetlens <command> --help."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from fleetlens.config import Thresholds
from fleetlens.operators import history
from fleetlens.operators.rules import sort_alerts
from fleetlens.plans.detect import REPLAY, detect, replay, rule_counts
from fleetlens.plans.lake import Lake
from fleetlens.schema import FACTS
from fleetlens.session import build_session
from fleetlens.sources import sinks
from fleetlens.sources.tables import read_chunks
from fleetlens.streaming.ingest import ingest_files, ingest_once, ingest_stream, read_ledger, table_path


def show(df) -> None:
    """Print all rows, as they come."""
    print(" | ".join(df.columns))
    for row in df.toLocalIterator():
        print(" | ".join("" if value is None else str(value) for value in row))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fleetlens", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, data: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=about)
        if data:
            where = sub.add_mutually_exclusive_group(required=True)
            where.add_argument("--data", help="folder of raw chunk tables")
            where.add_argument("--lake", help="folder of an ingested lake")
            where.add_argument("--namespace", help="catalog namespace")
            sub.add_argument("--asof", type=float, default=0.0, help="minutes before the data end")
            for name in ("heap_limit_mb", "io_z_threshold", "retrans_pct", "latency_x"):
                sub.add_argument(f"--{name.replace('_', '-')}", dest=name)
        return sub

    found = command("detect", "run every rule and deliver the alerts")
    found.add_argument("--json", help="write the alerts as JSON lines")
    found.add_argument("--table", help="append the alerts to this table folder")
    found.add_argument("--digest", action="store_true", help="print the alert messages")
    command("replay", "alerts per rule at 45, 30, 15 and 0 minutes before the end")
    command("ask", "answer a question").add_argument("question")
    command("sql", "run one read-only statement").add_argument("statement")
    command("trace", "dependencies of an app").add_argument("app")

    load = command("ingest", "load new raw chunks into a lake", data=False)
    load.add_argument("--raw", required=True)
    load.add_argument("--lake", required=True)
    load.add_argument("--watch", type=float, metavar="SECONDS", help="poll instead of stopping")
    load.add_argument("--batch", action="store_true", help="list the chunks instead of streaming them")
    command("history", "batches of a lake", data=False).add_argument("--lake", required=True)
    return top


def load(spark, args) -> None:
    topology = read_chunks(spark, table_path(args.raw, "topology"), "topology")
    if not topology.isEmpty():
        print("topology rows:", sinks.write_dimension(topology, table_path(args.lake, "topology")))
    if args.watch:
        running = [ingest_stream(spark, args.raw, args.lake, table, args.watch) for table in FACTS]
        for query in running:
            query.awaitTermination()
    elif args.batch:
        for table in FACTS:
            print(table, "batches:", ingest_files(spark, args.raw, args.lake, table))
    else:
        show(ingest_once(spark, args.raw, args.lake).groupBy("table", "batch_id").agg(
            F.count("*").alias("chunks"), F.sum("rows").alias("rows")).orderBy("table", "batch_id"))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "ingest":
        return load(spark, args)
    if args.command == "history":
        ledger = read_ledger(spark, args.lake)
        show(history.table_sizes(ledger).orderBy("table"))
        return show(history.last_batches(ledger).orderBy("table", "batch_id"))

    given = {key: value for key, value in vars(args).items() if value is not None}
    lake = Lake.open(spark, args.data or args.lake or "", Thresholds.from_settings(given), args.namespace,
                     ingested=bool(args.lake))
    if args.command == "detect":
        alerts = detect(lake.metrics, lake.cfg, args.asof, ordered=False).persist()
        print(f"{alerts.count()} alert(s) as of {args.asof:.0f} minutes before the data end")
        show(sort_alerts(alerts).select("severity", "rule", "vm_id", "app", "headline"))
        if args.json:
            sinks.write_alerts_json(alerts, args.json)
        if args.table:
            sinks.append_alerts(alerts, args.table)
        if args.digest:
            for page in sinks.digest(alerts, args.asof).orderBy("page").toLocalIterator():
                print(page.payload)
    elif args.command == "replay":
        show(rule_counts(replay(lake.metrics, lake.cfg, REPLAY)).orderBy(F.desc("asof"), "rule", "severity"))
    elif args.command == "ask":
        for row in lake.answer(args.question, args.asof).toLocalIterator():
            print(row.line)
    elif args.command == "sql":
        lake.alerts(args.asof)
        print(lake.run_sql(args.statement).text())
    elif args.command == "trace":
        show(lake.trace_dependencies(args.app, args.asof))


if __name__ == "__main__":
    main()
