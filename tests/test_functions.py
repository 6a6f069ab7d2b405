import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import quantile, stats
from fleetlens.functions.ranking import position_by_slice, position_by_sort


def _values(seed=7):
    rng = np.random.default_rng(seed)
    parts = [
        ("normal", rng.normal(100, 15, 4000)), ("skewed", rng.exponential(40, 3000)),
        ("mixed", rng.normal(0, 5, 2000)), ("tiny", np.array([3.0])), ("pair", np.array([1.0, 2.0])),
        ("same", np.full(500, 42.5)), ("zeros", np.zeros(50)), ("band", 100 + rng.random(3000) / 1000),
        (None, rng.normal(7, 1, 100))]
    return pd.concat([pd.DataFrame({"g": g, "x": v.astype("float32")}) for g, v in parts])


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_percentile_is_exact(spark, p):
    data = _values()
    df = spark.createDataFrame(data, "g string, x float").unionByName(
        spark.createDataFrame([("normal", None), ("only-null", None)], "g string, x float"))
    got = {r.g: r.q for r in quantile.exact_percentile(df, ["g"], "x", p, "q").collect()}
    want = {g: np.quantile(v["x"].astype("float64"), p) for g, v in data.groupby("g", dropna=False)}
    want = {(None if isinstance(g, float) else g): v for g, v in want.items()}
    assert set(got) == set(want)
    for group, value in want.items():
        assert got[group] == pytest.approx(value, rel=1e-12, abs=1e-12)


def test_percentile_equals_the_built_in_bit_for_bit(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i}", float(np.float32(v))) for i in range(60) for v in rng.lognormal(3, 2, int(rng.integers(1, 60)))]
    rows += [(g, v) for g, vs in {"inf": [1.0, float("inf")] * 9, "both": [float("-inf"), float("inf")], "nan": [1.0, 2.0, float("nan")],
                                  "minus": [float("-inf")] * 3} .items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: repr(r.q) for r in quantile.exact_percentile(df, ["g"], "x", 0.95, "q").collect()}
    assert got == {r.g: repr(r.q) for r in df.groupBy("g").agg(F.percentile("x", 0.95).alias("q")).collect()}


def test_percentile_without_local_targets(spark, monkeypatch):
    monkeypatch.setattr(quantile, "MAX_LOCAL_TARGETS", 1)
    data = _values()
    df = spark.createDataFrame(data, "g string, x float")
    got = {r.g: r.q for r in quantile.exact_percentile(df, ["g"], "x", 0.95, "q").collect()}
    assert got["skewed"] == pytest.approx(np.quantile(data[data.g == "skewed"]["x"].astype("float64"), 0.95))


def test_log_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([
        rng.normal(0, 1e-6, 500), rng.normal(0, 1e9, 500), rng.normal(0, 1, 500),
        [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf]]))
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = df.select("x", quantile.log_bucket(F.col("x")).alias("b")).collect()
    buckets = [r.b for r in sorted(rows, key=lambda r: r.x)]
    assert buckets == sorted(buckets)
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(quantile.log_bucket(F.col("x"))).first()[0]
    assert nan > max(buckets)


def _check_positions(df, keys, order, got):
    pdf = df.toPandas().sort_values(keys + order, na_position="first", kind="stable")
    pdf["want"] = pdf.groupby(keys, dropna=False).cumcount()
    both = pdf.merge(got.toPandas(), on=keys + order)
    assert len(both) == len(pdf)
    assert (both["want"] == both["at"]).all()


def test_positions_with_one_hot_key(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 40))
        .alias("k"), F.timestamp_micros(F.col("id") * 977_000_000).alias("ts"),
        F.concat(F.lit("vm-"), F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string")).alias("name"))
    _check_positions(df.select("k", "ts"), ["k"], ["ts"],
                     position_by_slice(df.select("k", "ts"), ["k"], ["ts"], F.date_trunc("day", "ts"), "at"))
    _check_positions(df.select("k", "name"), ["k"], ["name"],
                     position_by_sort(df.select("k", "name"), ["k"], ["name"], "at"))


@pytest.mark.parametrize("digits", [0, 1])
def test_number_text_is_that_of_python(spark, digits):
    from fleetlens.functions.stats import tenth, whole
    values = [0.0, 0.5, 1.5, 2.5, -0.3, -0.5, -0.04, -1.5, 0.25, 0.75, -0.25, 12.5, 1234567.0, 1e9 + 0.5, 99.95001,
              2048.25, 2048.75, 3.14159, -7.96]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    text = (whole if digits == 0 else tenth)(F.col("x"))
    assert [r[0] for r in df.select(text).collect()] == [f"{v:.{digits}f}" for v in values]


def test_text_of_numbers(spark):
    rows = spark.createDataFrame([(0, 73.25), (1, -0.004), (2, None), (3, 2.5)], "i int, x double").orderBy("i")
    got = rows.select(stats.whole(F.col("x")), stats.tenth(F.col("x")), stats.hundredth(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("73", "73.2", "73.25"), ("-0", "-0.0", "-0.00"), (None, None, None), ("2", "2.5", "2.50")]
