"""Shortest paths, labels and connectivity as frontier relaxation over DataFrames.

Only nodes whose value improved in a round are expanded in the next.  Rounds end when nothing improves;
`max_rounds` raises instead of returning a partial answer.  State is cut by written tables.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rounds of a search whose results are kept apart before they are merged.
MERGED_ROUNDS = 8


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir (one of our own only where none is set and all runs on this machine)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends there, and plans know its true size (a checkpoint carries on
    estimates, which rounds of joins multiply beyond all bounds)."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shortest(edges: DataFrame, sources: DataFrame, keys: Sequence[str] = (), max_rounds: int = 10_000, targets: DataFrame | None = None, weight: Column | None = None) -> DataFrame:
    """keys, node, cost, label, prev: the cheapest way from any source (keys, node, cost, label) over edges
    (src, dst, cost; keys too if scenarios differ).  Ties go to the smaller label, then the smaller prev.

    targets: (node); costs are then not negative, and no node is kept that costs more than the cheapest target known in
    its scenario, so that a search reaches as far as its goal is and not over the whole graph.
    weight: an edge's cost in a scenario, by columns of the edges and of the keys (its cost, where this is left out).
    """
    keys = list(keys)
    on = [k for k in keys if k in edges.columns]
    best = F.min(F.struct("cost", "label", "prev")).alias("b")
    pick = [*keys, "node", "b.cost", "b.label", "b.prev"]
    start = sources.select(*keys, "node", F.col("cost").cast("double").alias("cost"), "label", F.lit(None).cast(edges.schema["src"].dataType).alias("prev"))
    frontier = cut(start.groupBy(*keys, "node").agg(best).select(*pick))
    # each round writes only what it bettered; a node's value is the least of all rounds, which are merged now and then
    rounds, held = 0, [frontier]
    merged = lambda: functools.reduce(DataFrame.unionByName, held).groupBy(*keys, "node").agg(best).select(*pick)
    step = edges.withColumnRenamed("cost", "_w").withColumnRenamed("src", "node")
    w = F.col("_w") if weight is None else weight
    ends = None if targets is None else targets.select("node").distinct()
    while frontier.limit(1).count():
        if rounds >= max_rounds:
            raise RuntimeError(f"not settled after {max_rounds} rounds")
        rounds += 1
        reach = frontier.join(step, ["node", *on]).select(*keys, F.col("dst").alias("_to"), (F.col("cost") + w).alias("cost"), "label", F.col("node").alias("prev")).withColumnRenamed("_to", "node")
        reach = reach.groupBy(*keys, "node").agg(best).select(*pick)
        known = merged().select(*keys, "node", F.col("cost").alias("_cost"), F.col("label").alias("_label"))
        better = F.col("_cost").isNull() | (F.struct("cost", "label") < F.struct("_cost", "_label"))
        reach = reach.join(known, [*keys, "node"], "left").where(better).select(*keys, "node", "cost", "label", "prev")
        if ends is not None:
            met = merged().unionByName(reach).join(ends, "node", "left_semi")
            goal = met.groupBy(*keys).agg(F.min("cost").alias("_goal")) if keys else met.agg(F.min("cost").alias("_goal"))
            reach = (reach.join(goal, keys, "left") if keys else reach.crossJoin(goal)).where("_goal IS NULL OR cost <= _goal").drop("_goal")
        frontier = cut(reach)
        held.append(frontier)
        if len(held) > MERGED_ROUNDS:
            held = [cut(merged())]
    return cut(merged())


def reach_by_group(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """grp, node, cost: the best node of each station group."""
    return paths.join(nodes.select("node", "grp"), "node").groupBy("grp").agg(F.min(F.struct("cost", "node")).alias("b")).select("grp", "b.node", "b.cost")


def trace(paths: DataFrame, targets: DataFrame, max_hops: int = 10_000) -> DataFrame:
    """target, hop (0 at the target), node: the way back along prev."""
    at = cut(targets.select(F.col("node").alias("target"), F.lit(0).alias("hop"), "node"))
    out = at
    for hop in range(1, max_hops + 1):
        at = cut(at.join(paths.select("node", "prev"), "node").where("prev is not null").select("target", F.lit(hop).alias("hop"), F.col("prev").alias("node")))
        if not at.limit(1).count():
            return out
        out = cut(out.unionByName(at))
    raise RuntimeError(f"a path has more than {max_hops} hops")


def line_graph(lines: DataFrame, digits: int = 5) -> DataFrame:
    """src, dst (rounded coordinate keys) and degrees between consecutive vertices, both directions."""
    key = lambda p: F.concat_ws(",", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string"))
    v = lines.select("line", F.posexplode("points").alias("i", "p"))
    w = Window.partitionBy("line").orderBy("i")
    seg = v.select("line", key(F.col("p")).alias("a"), key(F.lead("p").over(w)).alias("b"), F.col("p"), F.lead("p").over(w).alias("q")).where(F.col("q").isNotNull() & (F.col("a") != F.col("b")))
    d = F.sqrt(F.pow(F.col("p.x") - F.col("q.x"), 2) + F.pow(F.col("p.y") - F.col("q.y"), 2)).alias("cost")
    one = seg.select("line", F.col("a").alias("src"), F.col("b").alias("dst"), d)
    return one.unionByName(seg.select("line", F.col("b").alias("src"), F.col("a").alias("dst"), d))


def label_borders(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, cost: the cheapest link between each pair of neighbouring labels."""
    p = paths.select("node", "cost", "label")
    left = p.select(F.col("node").alias("src"), F.col("cost").alias("_cs"), F.col("label").alias("_a"))
    right = p.select(F.col("node").alias("dst"), F.col("cost").alias("_cd"), F.col("label").alias("_b"))
    both = edges.join(left, "src").join(right, "dst").where("_a <> _b")
    return both.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min(F.col("_cs") + F.col("cost") + F.col("_cd")).alias("cost"))


#: Mean speeds with stops (km/h) and dwell times (minutes) of the line categories.
SPEEDS = {0: 150.0, 1: 55.0, 2: 32.0, 3: 45.0, 4: 20.0}
DWELLS = {0: 1.0, 1: 0.7, 2: 0.6, 3: 0.7, 4: 0.5}


def ride_minutes(km: Column, category: Column, speeds: dict = SPEEDS, dwells: dict = DWELLS) -> Column:
    """Minutes of a ride at its category's speed and dwell; null for an unknown category."""
    return F.coalesce(*(F.when(category == name, km / kmh * 60 + dwells[name]) for name, kmh in speeds.items()))


def rides(borders: DataFrame, stations: DataFrame, speeds: dict = SPEEDS, dwells: dict = DWELLS) -> DataFrame:
    """a, b, minutes (2 digits), km (3 digits): the links of `borders` (a, b, cost in km) between neighbouring stations as
    rides, by the category of station a (label, category)."""
    kind = stations.select(F.col("label").alias("a"), "category")
    return borders.join(kind, "a").select("a", "b", F.round(ride_minutes(F.col("cost"), F.col("category"), speeds, dwells), 2).alias("minutes"), F.round("cost", 3).alias("km"))


def connected(edges: DataFrame, nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, component: the smallest node of each connected part (a, b are undirected edges).

    Parts merge along edges in rounds (`hooked`), and each round works on what the last one left between parts, at most
    half as many; the nodes themselves are read once at the end.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).where("u <> v").distinct()
    left = cut(both.withColumn("w", F.lit(0)))
    mergers: list[DataFrame] = []
    while not left.isEmpty():
        if len(mergers) == max_rounds:
            raise RuntimeError(f"not settled after {max_rounds} rounds")
        roots = cut(hooked(left, None).select("u", "root"))
        mergers.append(roots)
        moved = left.join(roots, "u").select(F.col("root").alias("ru"), F.col("v").alias("u")).join(roots, "u")
        left = cut(moved.where(F.col("ru") != F.col("root")).select(F.col("ru").alias("u"), F.col("root").alias("v"), F.lit(0).alias("w")).distinct())
    if not mergers:
        return nodes.select("node", F.col("node").alias("component"))
    parts = mergers[-1]
    for roots in reversed(mergers[:-1]):
        later = parts.select(F.col("u").alias("root"), F.col("root").alias("_top"))
        parts = roots.join(later, "root", "left").select("u", F.coalesce("_top", "root").alias("root"))
    placed = cut(nodes.join(parts.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("_root")))
    least = placed.groupBy("_root").agg(F.min("node").alias("component"))
    return placed.join(least, "_root").select("node", "component")


def hooked(edges: DataFrame, outside: int | None, max_rounds: int = 64) -> DataFrame:
    """u, w, root: one round of a spanning forest over edges (u, v, w; both directions, none from `outside`).

    Every node takes its lowest edge (ties by the edge's ends, the same from both sides), which makes trees with two
    nodes that chose each other, or `outside` (if there is one), at the end; of the two the smaller is the root.  Roots are found by
    doubling, so rounds grow with the logarithm of the longest chain; a node that has its root isn't read again.
    """
    order = F.struct("w", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "v")
    picks = cut(edges.groupBy("u").agg(F.min(order).alias("e")).select("u", F.col("e.w").alias("w"), F.col("e.v").alias("p")))
    back = picks.select(F.col("u").alias("p"), F.col("p").alias("_pp"))
    mutual = (F.col("_pp") == F.col("u")) & (F.col("u") < F.col("p"))
    state = picks.join(back, "p", "left").select("u", F.when(mutual, F.col("u")).otherwise(F.col("p")).alias("p"), (mutual | (F.col("p") == outside)).alias("ends"))
    state = cut(state.withColumn("ends", F.coalesce("ends", F.lit(False))))
    done: list[DataFrame] = []
    for _ in range(max_rounds):
        done.append(state.where("ends").select("u", F.col("p").alias("root")))
        open_ = state.where("not ends")
        if open_.isEmpty():
            return picks.select("u", "w").join(functools.reduce(DataFrame.unionByName, done), "u")
        # a node that ends elsewhere than in itself has its root; one that is a root is all its followers'
        ahead = functools.reduce(DataFrame.unionByName, done).select(F.col("u").alias("p"), F.col("root").alias("_p"), F.lit(True).alias("_ends"))
        ahead = ahead.unionByName(open_.select(F.col("u").alias("p"), F.col("p").alias("_p"), F.lit(False).alias("_ends")))
        state = cut(open_.join(ahead, "p").select("u", F.col("_p").alias("p"), F.col("_ends").alias("ends")))
    raise RuntimeError(f"roots not found in {max_rounds} rounds")


def alternatives(edges: DataFrame, sources: DataFrame, targets: DataFrame, worst: float = 1.6, keep: int = 3, factor: float = 8.0) -> DataFrame:
    """rank, cost, lines (array, in order of riding), nodes: the best way and up to `keep` - 1 others.

    edges: src, dst, cost, line (null for a transfer).  Each of the three longest ridden lines of the best way is made
    `factor` times as slow in turn; all these scenarios are solved in one loop.  Ways are counted at their true
    cost, those of the same lines once, none over `worst` times the best.
    """
    plain = cut(edges.select("src", "dst", "cost", "line"))
    first = cut(_ways(plain, edges.sparkSession.createDataFrame([("",)], "scenario string"), sources, targets, factor))
    legs = first.select(F.explode("hops").alias("h")).where("h.line is not null").groupBy("h.line").agg(F.sum("h.cost").alias("_c")).orderBy(F.desc("_c"), "line").limit(3)
    slow = cut(legs.select(F.col("line").alias("scenario")))
    ways = first.unionByName(_ways(plain, slow, sources, targets, factor))
    ways = ways.withColumn("lines", F.filter(F.transform("hops", lambda h: h["line"]), lambda x: x.isNotNull()))
    # consecutive rides on one line are one
    ridden = F.filter(F.transform("lines", lambda x, i: F.when((i == 0) | (F.get("lines", i - 1) != x), x)), lambda x: x.isNotNull())
    ways = cut(ways.select("scenario", "cost", ridden.alias("lines"), F.concat(F.array(F.col("hops")[0]["src"]), F.transform("hops", lambda h: h["dst"])).alias("nodes")))
    best = ways.agg(F.min("cost").alias("_best"))
    once = ways.groupBy("lines").agg(F.min(F.struct("cost", "nodes")).alias("w")).select("lines", "w.cost", "w.nodes")
    near = once.crossJoin(F.broadcast(best)).where(F.col("cost") <= F.col("_best") * worst).drop("_best").orderBy("cost", "nodes").limit(keep)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("cost", "nodes"))).select("rank", "cost", "lines", "nodes")


def _ways(edges: DataFrame, names: DataFrame, sources: DataFrame, targets: DataFrame, factor: float) -> DataFrame:
    """scenario, cost (by the edges), hops (array of struct src, dst, cost, line): the best way of each of the scenarios
    `names`, in which the line of that name costs `factor` times as much."""
    slowed = lambda cost: F.when(F.col("line") == F.col("scenario"), cost * factor).otherwise(cost)
    paths = shortest(edges, sources.crossJoin(F.broadcast(names)), keys=["scenario"], targets=targets, weight=slowed(F.col("_w")))
    ends = paths.join(targets.select("node"), "node").groupBy("scenario").agg(F.min(F.struct("cost", "node")).alias("e")).select("scenario", "e.node")
    at, rows, hop = cut(ends), None, 0
    while rows is None or at.limit(1).count():
        back = cut(at.join(paths.select("scenario", "node", "prev"), ["scenario", "node"]).where("prev is not null").select("scenario", F.col("prev").alias("src"), F.col("node").alias("dst"), F.lit(-hop).alias("i")))
        rows = back if rows is None else rows.unionByName(back)
        at, hop = back.select("scenario", F.col("src").alias("node")), hop + 1
    # of parallel edges the one that made the scenario's way
    priced = rows.join(edges, ["src", "dst"]).groupBy("scenario", "src", "dst", "i").agg(F.min(F.struct(slowed(F.col("cost")).alias("slow"), F.coalesce("line", F.lit("")).alias("name"), "cost", "line")).alias("b"))
    priced = priced.select("scenario", "src", "dst", "i", "b.cost", "b.line")
    hops = F.transform(F.array_sort(F.collect_list(F.struct("i", "src", "dst", "cost", "line"))), lambda h: F.struct(h["src"].alias("src"), h["dst"].alias("dst"), h["cost"].alias("cost"), h["line"].alias("line")))
    return priced.groupBy("scenario").agg(F.sum("cost").alias("cost"), hops.alias("hops"))
