"""Flood connectivity on grids (row, col, elev): labels, dilation, banks, minimax flood levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: The four neighbours of a grid cell.
STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))


def neighbours(cells: DataFrame) -> DataFrame:
    """The cells with `nrow`, `ncol`: one row for each of the four neighbours."""
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in STEPS))
    return cells.withColumn("_s", F.explode(steps)).withColumn("nrow", F.col("row") + F.col("_s.r")).withColumn("ncol", F.col("col") + F.col("_s.c")).drop("_s")


#: The node that stands for the water outside, from which seeds are reached at their own height.
OUTSIDE = -(1 << 63)


def flood_levels(grid: DataFrame, seeds: DataFrame, max_rounds: int = 64) -> DataFrame:
    """row, col, level: the lowest water level at which each cell is reached from the seeds (the least over paths of
    the highest cell on the way); cells that aren't reached are left out.

    Least highest ways are those of a minimum spanning forest, which grows in rounds: every part takes its lowest edge
    outwards and merges with the part behind it, until all that can are joined to the water outside.  A part's cells
    all lie at its lowest edge or higher, and edges fall along the way to the part that all others of a merger
    lead to; so a cell's level is the highest edge that the parts it was in took.  Parts at least halve every round.
    """
    key = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32).bitwiseOR(F.col(c).cast("long").bitwiseAND(0xFFFFFFFF))
    cells = graph.cut(grid.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("elev").cast("double").alias("elev")))
    near = neighbours(cells).select(key("row", "col").alias("u"), "elev", F.col("nrow").alias("row"), F.col("ncol").alias("col"))
    edges = near.join(cells.withColumnRenamed("elev", "_e"), ["row", "col"]).select("u", key("row", "col").alias("v"), F.greatest("elev", "_e").alias("w"))
    start = cells.join(seeds.select("row", "col").distinct(), ["row", "col"], "left_semi").select(key("row", "col").alias("u"), F.lit(OUTSIDE).alias("v"), F.col("elev").alias("w"))
    edges = graph.cut(edges.unionByName(start))
    mergers: list[DataFrame] = []
    for _ in range(max_rounds):
        merger = graph.hooked(edges, OUTSIDE)
        mergers.append(merger)
        roots = merger.select("u", "root")
        moved = edges.join(roots, "u").where(F.col("root") != OUTSIDE).select(F.col("root").alias("ru"), F.col("v").alias("u"), "w")
        # what leads outside does so for good
        inner = moved.where(F.col("u") != OUTSIDE).join(roots, "u").select("ru", F.col("root").alias("rv"), "w")
        both = inner.unionByName(moved.where(F.col("u") == OUTSIDE).select("ru", F.lit(OUTSIDE).alias("rv"), "w")).where("ru <> rv")
        edges = graph.cut(both.groupBy(F.col("ru").alias("u"), F.col("rv").alias("v")).agg(F.min("w").alias("w")))
        if edges.isEmpty():
            break
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    # from the last round to the first: a part's level is its edge's or that of what it became
    levels = None
    for merger in reversed(mergers):
        own = merger.where(F.col("root") == OUTSIDE).select("u", F.col("w").alias("level"))
        if levels is not None:
            later = merger.where(F.col("root") != OUTSIDE).join(levels.withColumnRenamed("u", "root"), "root")
            own = own.unionByName(later.select("u", F.greatest("w", "level").alias("level")))
        levels = graph.cut(own)
    return cells.withColumn("u", key("row", "col")).join(levels, "u").select("row", "col", "level")


def sea_water(water: DataFrame, edge: DataFrame, least: int) -> DataFrame:
    """Water cells connected to `edge` cells in parts of at least `least` cells."""
    key = lambda r, c: F.shiftleft(F.col(r).cast("long"), 32).bitwiseOR(F.col(c).cast("long"))
    nodes = water.select(key("row", "col").alias("node"), "row", "col")
    pairs = neighbours(water.select("row", "col")).select(key("row", "col").alias("a"), key("nrow", "ncol").alias("b")).where("a < b")
    pairs = pairs.join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    parts = graph.connected(pairs.select("a", "b"), nodes.select("node")).join(nodes, "node")
    big = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("component")
    touching = parts.join(edge.select("row", "col").distinct(), ["row", "col"], "left_semi").select("component").distinct()
    return parts.join(big, "component", "left_semi").join(touching, "component", "left_semi").select("row", "col")


def dilated(cells: DataFrame, k: int) -> DataFrame:
    """The cells within k four-neighbour steps."""
    out = cells.select("row", "col").distinct()
    for _ in range(k):
        out = out.unionByName(neighbours(out).select(F.col("nrow").alias("row"), F.col("ncol").alias("col"))).distinct()
    return out


def _nearest_in_row(far: pd.DataFrame, land: pd.DataFrame) -> pd.DataFrame:
    """The banks of one row's water cells from each column's land nearest to the row: columns outwards from the cell
    until they alone are further than the best found."""
    far = far.reset_index(drop=True)
    if far.empty or land.empty:
        return far.iloc[:0].assign(bank=np.zeros(0))
    land = land.sort_values(["lcol", "up", "elev"]).drop_duplicates("lcol")
    low = int(land["lcol"].min())
    width = int(land["lcol"].max()) - low + 1
    none = np.iinfo(np.int64).max
    up, elev = np.full(width, none), np.zeros(width, land["elev"].dtype)
    up[land["lcol"] - low], elev[land["lcol"] - low] = land["up"].to_numpy(np.int64) ** 2, land["elev"]
    col = far["col"].to_numpy(np.int64) - low
    d, bank, k, open_ = np.full(len(far), none), np.zeros(len(far), elev.dtype), 0, np.arange(len(far))
    while len(open_):
        for at in (col[open_] - k, col[open_] + k):
            inside = (at >= 0) & (at < width)
            i, at = open_[inside], at[inside]
            some = up[at] < none
            i, at = i[some], at[some]
            new = up[at] + k * k
            better = (new < d[i]) | ((new == d[i]) & (elev[at] < bank[i]))
            d[i[better]], bank[i[better]] = new[better], elev[at[better]]
        k += 1
        open_ = open_[d[open_] >= k * k]
    return far.assign(bank=bank)


def _far_land(rest: DataFrame, land: DataFrame) -> DataFrame:
    """row, col, bank for water cells at any distance: each column's land is dealt to the rows it is nearest to, and
    each row looks along its columns (an exact distance transform, linear in the grid)."""
    low, high = rest.agg(F.min("row"), F.max("row")).first()
    column = Window.partitionBy("lcol").orderBy("lrow")
    first = F.coalesce(F.ceil((F.lag("lrow").over(column) + F.col("lrow")) / 2), F.lit(low))
    last = F.coalesce(F.floor((F.lead("lrow").over(column) + F.col("lrow")) / 2), F.lit(high))
    near = land.select("lcol", "lrow", "elev", F.greatest(first, F.lit(low)).cast("long").alias("_a"), F.least(last, F.lit(high)).cast("long").alias("_b")).where("_a <= _b")
    near = near.withColumn("row", F.explode(F.sequence("_a", "_b"))).select("row", F.col("lcol").cast("long").alias("lcol"), F.abs(F.col("row") - F.col("lrow")).alias("up"), "elev")
    near = near.join(rest.select("row").distinct(), "row", "left_semi")
    kind = {f.name: f.dataType.simpleString() for f in (*rest.schema, *land.schema)}
    return rest.groupBy("row").cogroup(near.groupBy("row")).applyInPandas(_nearest_in_row, f"row {kind['row']}, col {kind['col']}, bank {kind['elev']}")


def nearest_land(grid: DataFrame, water: DataFrame, rings: int) -> DataFrame:
    """row, col, bank: the value of the land cell nearest to each water cell (smaller value of equals), at any
    distance; only a grid without land gives no rows.  Land is looked for in growing squares up to `rings` cells,
    and for the water cells that these don't prove by columns and rows."""
    land = grid.join(water.select("row", "col"), ["row", "col"], "left_anti").select(F.col("row").alias("lrow"), F.col("col").alias("lcol"), "elev")
    rest, out, r = water.select("row", "col").distinct(), None, 1
    while True:
        span = F.sequence(F.lit(-r), F.lit(r))
        near = rest.withColumn("_r", F.explode(span)).withColumn("_c", F.explode(span)).select("row", "col", (F.col("row") + F.col("_r")).alias("lrow"), (F.col("col") + F.col("_c")).alias("lcol"), (F.col("_r") * F.col("_r") + F.col("_c") * F.col("_c")).alias("d"))
        best = near.join(land, ["lrow", "lcol"]).groupBy("row", "col").agg(F.min(F.struct("d", "elev")).alias("b"))
        # a square only proves distances up to its half side
        sure = graph.cut(best.where(F.col("b.d") <= r * r).select("row", "col", F.col("b.elev").alias("bank")))
        out = sure if out is None else out.unionByName(sure)
        rest = graph.cut(rest.join(sure, ["row", "col"], "left_anti"))
        if not rest.limit(1).count():
            return out
        if r >= rings:
            return out.unionByName(_far_land(rest, land))
        r = min(2 * r, rings)


def with_barriers(grid: DataFrame, barrier: DataFrame, height: float) -> DataFrame:
    """Cells of line barriers raised to a fixed height."""
    marked = barrier.select("row", "col").distinct().withColumn("_b", F.lit(True))
    return grid.join(marked, ["row", "col"], "left").select("row", "col", F.when(F.col("_b"), F.greatest("elev", F.lit(height))).otherwise(F.col("elev")).alias("elev"))


def covered_cells(subcells: DataFrame, share: float = 0.45) -> DataFrame:
    """Cells whose 3x3 subcells (row, col, inside) are covered for at least `share`."""
    return subcells.groupBy(F.floor(F.col("row") / 3).cast("int").alias("row"), F.floor(F.col("col") / 3).cast("int").alias("col")).agg(F.avg(F.col("inside").cast("int")).alias("_s")).where(F.col("_s") >= share).select("row", "col")


#: The height of a barrier, what counts as one, and the least level that floods land (metres).
WALL, WALL_FROM, LAND_LEAST = 20.0, 19.0, 0.1


def flood_grid(grid: DataFrame, water: DataFrame, barriers: DataFrame | None = None, edge: DataFrame | None = None, bank_least: float = 0.0, least_cells: int = 50) -> DataFrame:
    """row, col, elev, level: what the sea reaches at which level; a null level is never reached.

    water: row, col, managed (canals and basins held at a level, through which the sea doesn't come in).  Water lies at
    0 at most; barriers (row, col) are walls; with `edge` (row, col) only water connected to it rises; managed water
    is crossed at the height of its nearest bank; `bank_least` raises a band of two cells around open water.
    Land counts and floods at LAND_LEAST at least.
    """
    wet = water.groupBy("row", "col").agg(F.min("managed").alias("managed"))
    cells = grid.join(wet, ["row", "col"], "left").select("row", "col", F.when(F.col("managed").isNotNull(), F.least("elev", F.lit(0.0))).otherwise(F.col("elev")).alias("elev"), "managed")
    if barriers is not None:
        walls = barriers.select("row", "col").distinct().withColumn("_b", F.lit(True))
        cells = cells.join(walls, ["row", "col"], "left").withColumn("elev", F.when(F.col("_b"), F.lit(WALL)).otherwise(F.col("elev"))).drop("_b")
    cells = graph.cut(cells)
    open_ = cells.where("managed = false").where(F.col("elev") < WALL).select("row", "col")
    seeds = open_ if edge is None else sea_water(open_, edge, least_cells)
    low = F.col("elev") < WALL_FROM
    fill = cells
    canals = cells.where("managed = true")
    if canals.limit(1).count():
        land = cells.where(F.col("managed").isNull() & low).select("row", "col", "elev")
        banks = nearest_land(land.unionByName(canals.select("row", "col", "elev")), canals.select("row", "col"), 16)
        fill = fill.join(banks, ["row", "col"], "left").withColumn("elev", F.when(F.col("bank").isNotNull() & low, F.greatest("bank", F.lit(LAND_LEAST))).otherwise(F.col("elev"))).drop("bank")
    if bank_least:
        band = dilated(open_, 2).join(open_, ["row", "col"], "left_anti").withColumn("_band", F.lit(True))
        low_now = cells.where(low).select("row", "col").withColumn("_low", F.lit(True))
        fill = fill.join(band, ["row", "col"], "left").join(low_now, ["row", "col"], "left")
        fill = fill.withColumn("elev", F.when(F.col("_band") & F.col("_low"), F.greatest("elev", F.lit(bank_least))).otherwise(F.col("elev"))).drop("_band", "_low")
    levels = flood_levels(fill.select("row", "col", "elev"), seeds)
    dry = F.col("managed").isNull()
    held = lambda c: F.when(dry, F.greatest(F.col(c), F.lit(LAND_LEAST))).otherwise(F.col(c))
    both = cells.join(levels, ["row", "col"], "left")
    return both.select("row", "col", held("elev").alias("elev"), F.when(F.col("level").isNotNull(), held("level")).alias("level"))


def exposure(features: DataFrame, flooded: DataFrame, west: float, north: float, step: float, rows: int, cols: int) -> DataFrame:
    """The features (id, lon, lat) with `level`, at which each floods (LAND_LEAST at least; null: never), and `ground`."""
    from . import joins

    at = joins.sample_grid(features, flooded, west, north, step, rows, cols)
    level = F.when(F.col("level").isNotNull(), F.round(F.greatest("level", F.lit(LAND_LEAST)), 2))
    return at.select(*features.columns, level.alias("level"), F.round(F.greatest("elev", F.lit(0.0)), 1).alias("ground"))


def line_cells(segments: DataFrame, west: float, north: float, step: float, width: int = 4) -> DataFrame:
    """row, col: the cells within half of `width` cells of line segments (x1, y1, x2, y2), by points a quarter of a
    cell apart."""
    c = lambda a: (F.col(a) - west) / step if a.startswith("x") else (north - F.col(a)) / step
    rows = segments.select(*(c(a).alias(a) for a in ("x1", "y1", "x2", "y2")))
    n = F.greatest(F.ceil(4 * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.lit(1)).cast("int")
    points = rows.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n")))).select((F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("_k") / F.col("_n")).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("_k") / F.col("_n")).alias("y"))
    reach = width // 2
    around = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(q).alias("q")) for r in range(-reach, reach + 1) for q in range(-reach, reach + 1)))).alias("_o")
    near = points.select("x", "y", around).select("x", "y", (F.floor("y") + F.col("_o.r")).cast("int").alias("row"), (F.floor("x") + F.col("_o.q")).cast("int").alias("col"))
    return near.where(F.hypot(F.col("col") + 0.5 - F.col("x"), F.col("row") + 0.5 - F.col("y")) <= width / 2).select("row", "col").distinct()


def polygon_cells(polygons: DataFrame, west: float, north: float, step: float, share: float = 0.45) -> DataFrame:
    """row, col: the grid cells that polygons (ring, perhaps `holes`, an array of rings) cover for at least `share`, by
    3 x 3 points in each cell; a point counts where it is in any polygon and not in that polygon's holes.

    Each edge meets the rows of points between its ends; along a row, the crossings by rising x enclose runs of points
    (even-odd), so no point is tested against a ring.
    """
    fine = step / 3
    rings = F.concat(F.array("ring"), F.coalesce("holes", F.expr("array()"))) if "holes" in polygons.columns else F.array("ring")
    rows = polygons.where(F.size("ring") >= 3).select(rings.alias("_rings")).withColumn("_id", F.xxhash64("_rings")).distinct()
    edge = lambda ring: F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    edges = rows.select("_id", F.explode(F.flatten(F.transform("_rings", edge))).alias("e")).select("_id", "e.*").where("y1 <> y2")
    # the rows of points with y between the ends: from below the upper end to above the lower one
    first, last = F.floor((north - F.greatest("y1", "y2")) / fine - 0.5), F.ceil((north - F.least("y1", "y2")) / fine - 0.5)
    y = north - (F.col("row") + 0.5) * fine
    met = edges.withColumn("row", F.explode(F.sequence(first.cast("int"), last.cast("int")))).where((F.col("y1") > y) != (F.col("y2") > y))
    crossings = met.select("_id", "row", ((F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))
    order = Window.partitionBy("_id", "row").orderBy("x")
    runs = crossings.withColumn("_i", F.row_number().over(order)).withColumn("_end", F.lead("x").over(order)).where("_i % 2 = 1")
    # points x with start <= x < end
    at = lambda c: F.ceil((F.col(c) - west) / fine - 0.5).cast("int")
    inside = runs.select("row", at("x").alias("_a"), (at("_end") - 1).alias("_b")).where("_a <= _b").select("row", F.explode(F.sequence("_a", "_b")).alias("col")).distinct()
    cell = inside.groupBy(F.floor(F.col("row") / 3).cast("int").alias("row"), F.floor(F.col("col") / 3).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("_n"))
    return cell.where(F.col("_n") / 9 >= share).select("row", "col")
