"""Walks over the app dependency graph.

Downstream follows edges from a dependency to the apps that need it (who is hit
if it fails); upstream follows them the other way (what it needs). Reachability
is a frontier iteration: each level is one distributed join, and the level is
written out before the next, so plans stay short however deep the graph is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.functions.sizing import small_side
from fleetlens.session import checkpoint, checkpoint_counted

DOWNSTREAM, UPSTREAM = "downstream", "upstream"
# Levels whose results are merged into one table before going on.
MERGE_EVERY = 8


def edges(topology: DataFrame) -> DataFrame:
    """Distinct (app, depends_on_app); topology repeats an edge once per VM."""
    named = F.col("depends_on_app").isNotNull() & (F.col("depends_on_app") != "")
    return topology.filter(named).select("app", "depends_on_app").distinct()


def build_topology(fleet: DataFrame, edge_list: DataFrame) -> DataFrame:
    """One row per VM and dependency. Apps without dependencies have no rows."""
    return fleet.join(small_side(edge_list), "app").select("vm_id", "app", "site", "depends_on_app")


def roots_of(spark: SparkSession, *apps: str) -> DataFrame:
    return spark.createDataFrame([(app,) for app in apps], "root string")


def all_roots(edge_set: DataFrame) -> DataFrame:
    """Every app that is named on either end of an edge."""
    return (edge_set.select(F.col("app").alias("root"))
            .union(edge_set.select(F.col("depends_on_app").alias("root"))).distinct())


def _steps(edge_set: DataFrame, *directions: str) -> DataFrame:
    """(direction, src, dst): the edges as they are walked."""
    need, of = F.col("app"), F.col("depends_on_app")
    ways = []
    for direction in directions:
        if direction not in (DOWNSTREAM, UPSTREAM):
            raise ValueError(f"direction must be {DOWNSTREAM} or {UPSTREAM}")
        src, dst = (of, need) if direction == DOWNSTREAM else (need, of)
        ways.append(F.struct(F.lit(direction).alias("direction"), src.alias("src"), dst.alias("dst")))
    return edge_set.select(F.explode(F.array(*ways)).alias("way")).select("way.*")


def _advance(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    here = frontier.select("direction", "root", F.col("app").alias("src"))
    return here.join(steps, ["direction", "src"]).select("direction", "root", F.col("dst").alias("app")).distinct()


def _start(roots: DataFrame, *directions: str) -> DataFrame:
    way = F.explode(F.array(*[F.lit(d) for d in directions]))
    return roots.select("root").distinct().select(way.alias("direction"), "root", F.col("root").alias("app"))


def _explore(edge_set: DataFrame, start: DataFrame, directions: list[str], max_depth: int | None) -> DataFrame:
    """(direction, root, app, depth) for all starts of both directions at once:
    one level of every walk per round."""
    steps = small_side(checkpoint(_steps(edge_set, *directions)))
    frontier = checkpoint(start.withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = _advance(frontier, steps).join(seen, ["direction", "root", "app"], "left_anti")
        frontier, found = checkpoint_counted(fresh.withColumn("depth", F.lit(depth)))
        if not found:
            break
        seen = seen.unionByName(frontier)
        if depth % MERGE_EVERY == 0:
            seen = checkpoint(seen)
    return seen.filter(F.col("depth") > 0)


def reach(edge_set: DataFrame, roots: DataFrame, direction: str = DOWNSTREAM,
          max_depth: int | None = None) -> DataFrame:
    """(root, app, depth): every app reached from each root, at its least depth.

    An app already seen for a root is not expanded again, so cycles end; the root
    itself is never part of its own result.
    """
    return _explore(edge_set, _start(roots, direction), [direction], max_depth).select("root", "app", "depth")


def all_pairs(edge_set: DataFrame) -> DataFrame:
    """(src, dst, depth): every app that a failing one reaches, at its least depth, in a round for each doubling of the depth.

    The shortest path of a length in (h, 2h] starts with one of length h and goes on with one of at most h, so a round
    joins the pairs at depth h with all known ones. A chain of a thousand apps takes eleven rounds, where a walk level by
    level takes a thousand. There are up to V * V pairs: for few roots of a shallow graph ``reach`` does less.
    Cycles need no care, as shortest paths visit no app twice; a pair of an app with itself is left out.
    """
    known = checkpoint(edge_set.filter("app <> depends_on_app")
                       .select(F.col("depends_on_app").alias("src"), F.col("app").alias("dst"), F.lit(1).alias("depth")).distinct())
    h = 1
    while True:
        head = known.filter(F.col("depth") == h).select("src", F.col("dst").alias("mid"))
        tail = known.select(F.col("src").alias("mid"), "dst", "depth")
        longer = (head.join(small_side(tail), "mid").filter("src <> dst").groupBy("src", "dst").agg((F.min("depth") + h).alias("depth")))
        fresh, found = checkpoint_counted(longer.join(known, ["src", "dst"], "left_anti"))
        if not found:
            return known
        known = checkpoint(known.unionByName(fresh))
        h *= 2


def reach_all(edge_set: DataFrame, *directions: str) -> DataFrame:
    """(direction, root, app, depth) for every app as a root: one closure, read both ways."""
    pairs = all_pairs(edge_set)
    ways = []
    for direction in directions:
        root, app = ("src", "dst") if direction == DOWNSTREAM else ("dst", "src")
        ways.append(F.struct(F.lit(direction).alias("direction"), F.col(root).alias("root"), F.col(app).alias("app"), F.col("depth")))
    return pairs.select(F.explode(F.array(*ways)).alias("way")).select("way.*")


def path_counts(edge_set: DataFrame, fault: str, symptom: str, max_hops: int = 40) -> DataFrame:
    """(hops, n_paths): along how many dependency paths of each length a failing app reaches a symptom.

    Nothing is listed: a level holds a number for each app, and levels from both ends meet in the middle. On graphs
    with cycles walks are counted, which may come by an app again.
    """
    spark = edge_set.sparkSession
    steps = small_side(checkpoint(_steps(edge_set, DOWNSTREAM).select("src", "dst")))
    count = "decimal(38,0)"

    def levels(start: str, here: str, there: str, number: int) -> list[DataFrame]:
        out = [checkpoint(roots_of(spark, start).select(F.col("root").alias("app"), F.lit(1).cast(count).alias("n")))]
        for _ in range(number):
            grown = (out[-1].join(steps, F.col("app") == F.col(here)).groupBy(F.col(there).alias("app"))
                     .agg(F.sum("n").cast(count).alias("n")))
            level, found = checkpoint_counted(grown)
            if not found:
                break
            out.append(level)
        return out

    ahead = levels(fault, "src", "dst", (max_hops + 1) // 2)
    behind = levels(symptom, "dst", "src", max_hops - (max_hops + 1) // 2)
    met = None
    for length in range(1, max_hops + 1):
        first = min(length, (max_hops + 1) // 2)
        if first >= len(ahead) or length - first >= len(behind):
            continue
        pair = (ahead[first].join(behind[length - first].withColumnRenamed("n", "m"), "app")
                .select(F.lit(length).alias("hops"), (F.col("n") * F.col("m")).cast(count).alias("n")))
        met = pair if met is None else met.unionByName(pair)
    if met is None:
        return spark.createDataFrame([], "hops int, n_paths decimal(38,0)")
    return met.groupBy("hops").agg(F.sum("n").cast(count).alias("n_paths"))


def hops(edge_set: DataFrame, roots: DataFrame, direction: str = DOWNSTREAM,
         max_hops: int = 5) -> DataFrame:
    """(root, app, hops): distinct path lengths of 1..max_hops.

    Unlike ``reach`` an app appears once per path length. A path uses no edge
    twice, so walks through a cycle end; ``max_hops`` bounds the edges a walk has
    to remember.
    """
    steps = checkpoint(_steps(edge_set, direction).select("src", "dst", F.struct("src", "dst").alias("edge")))
    none = F.array().cast("array<struct<src:string,dst:string>>")
    frontier = roots.select("root", F.col("root").alias("app"), none.alias("used")).distinct()
    found = None
    for step in range(1, max_hops + 1):
        taken = (frontier.join(steps, F.col("app") == F.col("src")).filter(~F.array_contains("used", F.col("edge")))
                 # in one order, so that ways over the same edges are one row
                 .select("root", F.col("dst").alias("app"), F.array_sort(F.array_append("used", F.col("edge"))).alias("used"))
                 .distinct())
        frontier, rows = checkpoint_counted(taken)
        level = frontier.select("root", "app", F.lit(step).alias("hops")).distinct()
        found = level if found is None else found.unionByName(level)
        if not rows:
            break
    return found


def paths(edge_set: DataFrame, fault: str, symptom: str) -> DataFrame:
    """(fault, symptom, path, hops): every dependency path along which a failing
    app reaches a symptom, without visiting an app twice."""
    spark = edge_set.sparkSession
    # Only apps that lie between the two can be on a path: those hit by the
    # fault and needed by the symptom.
    ends = spark.createDataFrame(
        [(DOWNSTREAM, fault, fault), (UPSTREAM, symptom, symptom)], "direction string, root string, app string")
    near = _explore(edge_set, ends, [DOWNSTREAM, UPSTREAM], None)
    inner = (near.groupBy("app").agg(F.count_distinct("direction").alias("n")).filter("n = 2").select("app")
             .union(ends.select("app")).distinct())
    steps = checkpoint(
        _steps(edge_set, DOWNSTREAM)
        .join(inner.withColumnRenamed("app", "src"), "src", "left_semi")
        .join(inner.withColumnRenamed("app", "dst"), "dst", "left_semi").select("src", "dst"))

    walk = roots_of(spark, fault).select(F.array("root").alias("path"), F.col("root").alias("app"))
    found, open_paths = None, 1
    while open_paths:
        walk, open_paths = checkpoint_counted(
            walk.filter(F.col("app") != symptom).join(steps, F.col("app") == F.col("src"))
            .filter(~F.array_contains("path", F.col("dst")))
            .select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("app")))
        arrived = walk.filter(F.col("app") == symptom)
        found = arrived if found is None else found.unionByName(arrived)
    return found.select(F.lit(fault).alias("fault"), F.lit(symptom).alias("symptom"), "path",
                        (F.size("path") - 1).alias("hops"))


def alert_tags(alerts: DataFrame) -> DataFrame:
    """(app, tags): the distinct severity:rule tags of an app, sorted and joined.

    Tags are made distinct first, so the set holds at most severities x rules.
    """
    tag = F.concat_ws(":", "severity", "rule")
    return (alerts.select("app", tag.alias("tag")).distinct()
            .groupBy("app").agg(F.array_join(F.sort_array(F.collect_set("tag")), ", ").alias("tags")))


def trace(topology: DataFrame, roots: DataFrame | None, alerts: DataFrame) -> DataFrame:
    """(root, direction, depth, app, tags): both directions of every root, each
    app with its active alerts (empty when it has none). No roots means all apps."""
    both = [DOWNSTREAM, UPSTREAM]
    if roots is None:
        reached = reach_all(edges(topology), *both)
    else:
        reached = _explore(edges(topology), _start(roots, *both), both, None)
    return (reached.join(alert_tags(alerts), "app", "left")
            .select("root", "direction", "depth", "app", F.coalesce("tags", F.lit("")).alias("tags")))


def vms_in_radius(edge_set: DataFrame, roots: DataFrame, vms: DataFrame, max_hops: int = 5) -> DataFrame:
    """(root, app, vm_id): VMs that run an app in the blast radius.

    ``vms`` is the topology or, better, the whole fleet: apps without
    dependencies are missing from the topology. One row per VM, as a list per
    app would grow with the fleet.
    """
    hit = reach(edge_set, roots, DOWNSTREAM, max_hops).select("root", "app")
    placed = vms.select("app", "vm_id").distinct()
    return placed.join(small_side(hit), "app").select("root", "app", "vm_id")
