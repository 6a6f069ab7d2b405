"""Evaluation instants and their time windows.

An instant is "now" of a replay: data end minus some rule minutes. Its windows:

* recent    (end - 10, end]
* heap      (end - 30, end]
* baseline  [start, min(start + 30, end - 10))   never overlaps recent

Bounds are two scalars fetched once, so every later predicate is a literal that
reaches the Parquet reader and, for lake tables, prunes day partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.config import Thresholds


@dataclass(frozen=True)
class Instant:
    """One evaluation instant; all times in epoch microseconds."""

    asof: float
    start: int
    end: int
    recent_lo: int
    heap_lo: int
    base_hi: int


def at(us: int) -> Column:
    return F.timestamp_micros(F.lit(us))


@dataclass(frozen=True)
class Bounds:
    """First and last ts of the fact, and its row count where it is known."""

    start: int
    end: int
    n_rows: int | None = None


def data_bounds(metrics: DataFrame) -> Bounds:
    lake = "ts_day" in metrics.columns
    if lake:
        # The outermost day partitions hold both ends.
        days = metrics.agg(F.min("ts_day").alias("lo"), F.max("ts_day").alias("hi")).first()
        if days.lo is not None:
            metrics = metrics.filter(F.col("ts_day").isin(days.lo, days.hi))
    row = metrics.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi"),
                      F.count("*").alias("n")).first()
    if row.hi is None:
        raise ValueError("vm_metrics is empty")
    return Bounds(row.lo, row.hi, None if lake else row.n)


def instants(metrics: DataFrame, cfg: Thresholds, asof: float | Sequence[float] = 0.0,
             bounds: Bounds | None = None) -> list[Instant]:
    bounds = bounds or data_bounds(metrics)
    unit = cfg.unit_us
    out = []
    for minutes in (asof if isinstance(asof, Sequence) else [asof]):
        end = bounds.end - round(minutes * unit)
        recent_lo = end - cfg.recent_min * unit
        out.append(Instant(
            asof=float(minutes), start=bounds.start, end=end, recent_lo=recent_lo,
            heap_lo=end - cfg.heap_min * unit,
            base_hi=min(bounds.start + cfg.baseline_min * unit, recent_lo)))
    return out


def between(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Rows with ts in [lo, hi], with the day predicate a lake table prunes by."""
    for bound, compare in ((lo, "__ge__"), (hi, "__le__")):
        if bound is None:
            continue
        df = df.filter(getattr(F.col("ts"), compare)(at(bound)))
        if "ts_day" in df.columns:
            df = df.filter(getattr(F.col("ts_day"), compare)(F.to_date(at(bound))))
    return df


def _base_ends(points: list[Instant]) -> list[int]:
    """Ends of the distinct baseline windows; late instants all share one."""
    return sorted({p.base_hi for p in points})


def _prefilter(df: DataFrame, points: list[Instant], heap: bool) -> DataFrame:
    """Drop what no window can contain; these are the predicates the scan gets."""
    ts, end, base_hi = F.col("ts"), max(p.end for p in points), max(p.base_hi for p in points)
    low = min(min(p.recent_lo, p.heap_lo) if heap else p.recent_lo for p in points)
    df = between(df, hi=end).filter((ts > at(low)) | (ts < at(base_hi)))
    if "ts_day" in df.columns:
        day = F.col("ts_day")
        df = df.filter((day >= F.to_date(at(low))) | (day <= F.to_date(at(base_hi))))
    return df


def _at_slot(values: list[Column]) -> Column:
    return F.array(*values)[F.col("slot")]


def tag_instants(df: DataFrame, points: list[Instant], heap: bool = True) -> DataFrame:
    """Rows that fall in a window, with ``slot`` and the flags ``in_recent``,
    ``in_heap`` and ``in_base``.

    A slot is an instant's recent and heap window (numbered like the instants)
    or one of the distinct baseline windows (numbered after them); a row appears
    once per slot it falls in. The slots are an explode in the map stage, so rows
    are repeated before the partial aggregation and never across a shuffle.
    ``spread_slots`` brings the aggregated slots back to instants. A single
    instant needs no repetition: all its windows are flags of slot 0.
    """
    ts = F.col("ts")
    df = _prefilter(df, points, heap)

    def low(p: Instant) -> int:
        return min(p.heap_lo, p.recent_lo) if heap else p.recent_lo

    if len(points) == 1:
        p, = points
        now = ts <= at(p.end)
        df = df.select(
            "*", F.lit(0).alias("slot"), at(p.end).alias("t_end"), (now & (ts > at(p.recent_lo))).alias("in_recent"),
            ((now & (ts > at(p.heap_lo))) if heap else F.lit(False)).alias("in_heap"),
            ((ts >= at(p.start)) & (ts < at(p.base_hi))).alias("in_base"))
        return df.filter(F.col("in_recent") | F.col("in_heap") | F.col("in_base"))

    start, ends = points[0].start, _base_ends(points)
    member = [(ts > at(low(p))) & (ts <= at(p.end)) for p in points]
    member += [(ts >= at(start)) & (ts < at(hi)) for hi in ends]
    # Only the slot number is exploded, and non-members go afterwards: both keep
    # the stage in generated code.
    df = (df.select("*", F.explode(F.array(*[F.when(m, i) for i, m in enumerate(member)])).alias("slot"))
          .filter(F.col("slot").isNotNull()))
    never = [at(points[0].end)] * len(ends)
    now = F.col("slot") < len(points)
    return df.select(
        "*", _at_slot([at(p.end) for p in points] + never).alias("t_end"),
        (now & (ts > _at_slot([at(p.recent_lo) for p in points] + never))).alias("in_recent"),
        ((now & (ts > _at_slot([at(p.heap_lo) for p in points] + never))) if heap else F.lit(False)).alias("in_heap"),
        (~now).alias("in_base"))


def slot_keys(points: list[Instant]) -> list[str]:
    """The grouping column that tells slots apart; none for a single instant."""
    return ["slot"] if len(points) > 1 else []


def label_slots(grouped: DataFrame, points: list[Instant]) -> DataFrame:
    """``asof`` and ``t_end`` instead of the slot, where slots are instants."""
    if len(points) == 1:
        times = [F.lit(points[0].asof), at(points[0].end)]
    else:
        times = [_at_slot([F.lit(p.asof) for p in points]), _at_slot([at(p.end) for p in points])]
    return grouped.select(
        times[0].alias("asof"), times[1].alias("t_end"), *[c for c in grouped.columns if c != "slot"])


def spread_slots(grouped: DataFrame, points: list[Instant], keys: list[str]) -> DataFrame:
    """Aggregated slots -> one row per instant and ``keys``, with asof and t_end.

    Every other column must be null or zero in the slots it does not belong to;
    a shared baseline row goes to each instant that uses it.
    """
    if len(points) == 1:
        return label_slots(grouped, points)
    ends = _base_ends(points)
    users = [[i] for i in range(len(points))] + [
        [i for i, p in enumerate(points) if p.base_hi == hi] for hi in ends]
    values = [name for name in grouped.columns if name not in ("slot", *keys)]
    point = F.explode(_at_slot([F.array(*[F.lit(i) for i in which]) for which in users]))
    merged = (grouped.select(point.alias("slot"), *keys, *values)
              .groupBy("slot", *keys).agg(*[F.max(name).alias(name) for name in values]))
    return label_slots(merged, points)
