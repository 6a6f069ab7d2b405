"""Closures by doubling, path counts, dimension versions, and routing by an index."""

import itertools
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import graph, questions, versions

DAY = [datetime(2026, 1, d, tzinfo=timezone.utc) for d in range(1, 6)]


def edges_of(spark, pairs):
    return spark.createDataFrame([(str(b), str(a)) for a, b in pairs], "app string, depends_on_app string")


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = graph.checkpoint_counted
    monkeypatch.setattr(graph, "checkpoint_counted", lambda df: rounds.append(1) or kept(df))
    found = graph.all_pairs(edges_of(spark, [(i, i + 1) for i in range(260)]))
    assert len(rounds) <= 10 and found.count() == 261 * 260 // 2
    assert found.filter("depth <> cast(dst as int) - cast(src as int)").isEmpty()


def test_closure_equals_the_walk_by_levels(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 4), (0, 5), (5, 4), (7, 8)]
    e = edges_of(spark, pairs)
    for direction in (graph.DOWNSTREAM, graph.UPSTREAM):
        want = sorted(map(tuple, graph.reach(e, graph.all_roots(e), direction).collect()))
        found = graph.reach_all(e, graph.DOWNSTREAM, graph.UPSTREAM).filter(F.col("direction") == direction)
        assert sorted(map(tuple, found.drop("direction").collect())) == want
    assert graph.all_pairs(e.limit(0)).count() == 0


def test_paths_are_counted_without_a_list(spark):
    # A ladder of 40 levels with two apps each: 2 ** 39 paths.
    rungs = [(f"{i}{x}", f"{i + 1}{y}") for i in range(39) for x, y in itertools.product("ab", "ab")]
    rungs += [("in", "0a"), ("in", "0b"), ("39a", "out"), ("39b", "out")]
    found = graph.path_counts(edges_of(spark, rungs), "in", "out", 60)
    assert [(r.hops, int(r.n_paths)) for r in found.collect()] == [(41, 2 ** 40)]


def test_path_counts_equal_the_listed_paths(spark):
    e = edges_of(spark, [(a, b) for a, b in itertools.combinations(range(8), 2) if (a * b) % 3 != 1])
    listed = graph.paths(e, "0", "7").groupBy("hops").count()
    want = sorted((r.hops, r["count"]) for r in listed.collect())
    assert sorted((r.hops, int(r.n_paths)) for r in graph.path_counts(e, "0", "7").collect()) == want
    assert graph.path_counts(e, "7", "0").count() == 0 and graph.path_counts(e, "0", "none").count() == 0


def test_versions_follow_the_loads(spark):
    loads = [[("a", "x"), ("b", None)], [("a", "x"), ("c", "z"), ("c", "z")], [("b", None), ("c", "z")], []]
    frames = [spark.createDataFrame(rows, "app string, depends_on_app string") for rows in loads]
    found = versions.first_versions(frames[0], DAY[0])
    for frame, at in zip(frames[1:], DAY[1:], strict=False):
        found = versions.merged(found, frame, at)
        again = versions.merged(found, frame, at)
        assert sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))  # a repeated load changes nothing
    for rows, at in zip(loads, DAY, strict=False):
        assert sorted(map(tuple, versions.as_of(found, at).collect()), key=repr) == sorted(set(rows), key=repr)
    changed = {r["at"].day: (r.opened, r.closed) for r in found.transform(versions.changes).collect()}
    assert changed == {1: (2, 0), 2: (1, 1), 3: (1, 1), 4: (0, 2)}
    assert versions.as_of(found, datetime(2025, 1, 1, tzinfo=timezone.utc)).count() == 0


@pytest.mark.parametrize("bound", [50_000, 0])
def test_index_routes_like_the_chain_of_conditions(spark, monkeypatch, bound):
    monkeypatch.setattr(questions, "small_side", lambda df: df if not bound else F.broadcast(df))
    apps = ["kafka", "ehr-api", "api", "billing-svc", "Übung-x", "hl7-ingest"]
    texts = ["what breaks if the EHR API fails", "mykafkaX and api", "billing svc slow", "Übung x?", "übung-x", "nothing", "", None,
             "ka", "hl7-ingest hl7 ingest", "kafk ehr-ap"]
    q = spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(texts)], "conv_id int, turn int, question string")
    dictionary = spark.createDataFrame([(a, i) for i, a in enumerate(apps)], "app string, position int")
    lowered = [a.lower() for a in apps]
    want = sorted(map(repr, questions.route(q, "other", lowered).collect()))
    found = questions.route_by_index(q, dictionary.withColumn("app", F.lower("app")), ["conv_id", "turn"], "other")
    assert sorted(map(repr, found.collect())) == want


def test_index_of_many_apps_stays_map_side(spark):
    dictionary = spark.range(10_000).select(F.concat(F.lit("svc-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("app"),
                                            F.col("id").alias("position"))
    q = spark.range(2_000).select("id", F.concat(F.lit("why is svc-"), F.lpad((F.col("id") * 5).cast("string"), 5, "0"), F.lit(
        " slow, and svc-09999?")).alias("question"))
    found = questions.route_by_index(q, dictionary, ["id"])
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and text.count("Python") == 0
    assert found.filter(F.expr("app <> concat('svc-', lpad(id * 5, 5, '0'))")).isEmpty()


@pytest.mark.parametrize("bound", [50_000, 0])
def test_index_finds_names_anywhere_in_a_text(spark, monkeypatch, bound):
    monkeypatch.setattr(questions, "small_side", lambda df: df if not bound else F.broadcast(df))
    long = "long-" + "name-" * 30 + "x"
    apps = ["zebra", long + "y", long, "?afoo", "fooÜbung", "mark\u00b2", "line one", "\U0001f600bar"]
    filler = "ab cd " * 1500  # several chunks
    texts = [None, "", "\U0001f600afoo", "x?afoo", f"{filler}ZEBRA{filler}", filler[:4094] + "zebra", filler[:4090] + "zebra", f"a {long}",
             f"a {long}Y", long[:-1], long.replace("-", " "), "a fooübung", "mark\u00b2", "line\none", "line one", "a\U0001f600bar",
             "zebra \U0001f600bar", "zebra", "zebra"]
    rows = [(i if i % 5 else None, i, t) for i, t in enumerate(texts)]
    q = spark.createDataFrame(rows, "conv_id int, turn int, question string")
    dictionary = spark.createDataFrame([(a, -i) for i, a in enumerate(apps)], "app string, position int")

    def named(text):
        text = (text or "").lower()
        return next((a for a in reversed(apps) if a.lower() in text or a.replace("-", " ").lower() in text), "other")

    found = {r.turn: r.app for r in questions.route_by_index(q, dictionary, ["conv_id", "turn"], "other").collect()}
    assert found == {i: named(t) for _, i, t in rows}


@pytest.mark.parametrize("bound", [50_000, 0])
def test_questions_under_one_key_share_their_names(spark, monkeypatch, bound):
    monkeypatch.setattr(questions, "small_side", lambda df: df if not bound else F.broadcast(df))
    q = spark.createDataFrame([(1, "kafka"), (1, "zebra"), (None, "zebra"), (None, "none"), (2, "zebra"), (2, "zebra")], "id int, question string")
    dictionary = spark.createDataFrame([("kafka", 0), ("zebra", 1)], "app string, position int")
    found = sorted(((r.id or 0), r.question, r.app) for r in questions.route_by_index(q, dictionary, ["id"], "other").collect())
    assert found == [(0, "none", "zebra"), (0, "zebra", "zebra"), (1, "kafka", "kafka"), (1, "zebra", "kafka"), (2, "zebra", "zebra"), (2, "zebra", "zebra")]


def test_texts_do_not_travel_once_for_every_place(spark, monkeypatch):
    monkeypatch.setattr(questions, "small_side", lambda df: df)
    q = spark.createDataFrame([(1, "why is kafka slow")], "id int, question string")
    dictionary = spark.createDataFrame([("kafka", 0), ("ehr-api", 1)], "app string, position int")
    plan = questions.route_by_index(q, dictionary, ["id"])._jdf.queryExecution().optimizedPlan()
    sides = [node.left().output().mkString(" ") for node in _nodes(plan)
             if node.nodeName() == "Join" and re.search(r"gram#\d+ = gram#\d+", node.condition().toString())]
    assert len(sides) == 1 and "gram#" in sides[0] and "_text#" not in sides[0]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))
