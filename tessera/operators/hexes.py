"""Hexagon cells of points, polygons and each other: fills, reports, descents, mismatch, drift.

Cells are ids of `functions.cells`; rings are arrays of struct (x = lon, y = lat) in degrees and may be closed or not.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, geo, hexgrid
from . import graph


def indexed(df: DataFrame, res: int, lat: str = "lat", lon: str = "lon", name: str = "cell") -> DataFrame:
    """Every row with the cell it lies in; rows keep whatever order column they have."""
    return df.withColumn(name, cells.at(F.col(lat), F.col(lon), res))


def reach_degrees(res: int) -> float:
    """No centre of a cell under one of this resolution is further from its centre (0.67 of the mean spacing of cells
    would do), so that the reach of a child lies within its parent's."""
    mean = 4 * math.pi / (2 + 120 * 7**res)
    return math.degrees(0.7 * math.sqrt(2 * mean / math.sqrt(3)))


def _edges(ring: Column) -> Column:
    """The edges of a ring, closed: x1, y1, x2, y2.  A ring whose end is its start 360 degrees on encloses the pole of
    its hemisphere and is led over it."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    pole = F.when(F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["y"]) < 0, -90.0).otherwise(90.0)
    corner = lambda p: F.struct(p["x"].alias("x"), pole.alias("y"))
    around = (F.abs(F.abs(last["x"] - first["x"]) - 360) < 1e-9) & (F.abs(last["y"] - first["y"]) < 1e-9)
    ring = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    whole = F.when(around, F.concat(ring, F.array(corner(F.element_at(ring, -1)), corner(F.element_at(ring, 1))))).otherwise(ring)
    ends = F.concat(F.slice(whole, F.lit(2), F.size(whole) - 1), F.slice(whole, F.lit(1), F.lit(1)))
    edges = F.zip_with(whole, ends, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


# The expressions below are SQL text: a level has many, and text is parsed in one go.
def _crossed(x0: str, x1: str, y: str, turned: bool = False) -> str:
    """Whether an odd number of `edges` lies between (x0, y) and (x1, y); turned: x and y exchanged."""
    ax, ay, bx, by = ("y1", "x1", "y2", "x2") if turned else ("x1", "y1", "x2", "y2")
    at = f"((g.{bx} - g.{ax}) * ({y} - g.{ay}) / (CASE WHEN g.{by} = g.{ay} THEN 1D ELSE g.{by} - g.{ay} END) + g.{ax})"
    return f"(size(filter(edges, g -> ((g.{ay} > {y}) != (g.{by} > {y})) AND (({x0} < {at}) != ({x1} < {at})))) % 2 = 1)"


def _touching(dx: str, dy: float) -> Column:
    """The `edges` that touch the box of half sides dx, dy around (x, y)."""
    a, b = "(g.x2 - g.x1)", "(g.y2 - g.y1)"
    near = f"least(g.x1, g.x2) <= x + {dx} AND greatest(g.x1, g.x2) >= x - {dx} AND least(g.y1, g.y2) <= y + {dy!r}D AND greatest(g.y1, g.y2) >= y - {dy!r}D"
    return F.expr(f"filter(edges, g -> {near} AND abs({a} * (y - g.y1) - {b} * (x - g.x1)) <= abs({a}) * {dy!r}D + abs({b}) * {dx} + 1e-9D)")


def _half_width(reach: float) -> str:
    """The half side in degrees of longitude of the box around a cap at latitude y; all around where it holds a pole."""
    return f"(CASE WHEN abs(y) + {reach!r}D >= 90 THEN 180D ELSE degrees(asin(least(1D, {math.sin(math.radians(reach))!r}D / cos(radians(y))))) END)"


def _base_cells() -> Column:
    ids = (np.int64(1) << 59) | (np.arange(122, dtype=np.int64) << 45) | ((np.int64(1) << 45) - 1)
    lat, lon = hexgrid.center_of(ids)
    rows = [{"cell": int(c), "x": float(b), "y": float(a)} for c, a, b in zip(ids, lat, lon)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<cell: long, x: double, y: double>>")


def shapes(polygons: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """keys, _shape of each polygon, and _shape, ring (and holes) once for each distinct one, dealt to many tasks: equal
    polygons are worked on once."""
    own = ["ring", "holes"] if "holes" in polygons.columns else ["ring"]
    rows = polygons.where(F.size("ring") >= 3).select(*keys, *own)
    if len(own) > 1:
        rows = rows.withColumn("holes", F.coalesce("holes", F.expr("array()")))
    once = graph.cut(rows.select(*own).distinct().withColumn("_shape", F.monotonically_increasing_id()))
    members = graph.cut(rows.join(once, own).select(*keys, "_shape"))
    return members, once.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def refined(polygons: DataFrame, res: int, keys: Sequence[str] = ("id",), spread_every: int = 2) -> DataFrame:
    """keys, cell: cells of `res` and coarser ones that together are the fill of each polygon (keys, ring, and `holes`,
    an array of rings, if there is such a column): all centres under a coarser cell lie in the polygon.

    From the base cells down, a cell that no edge comes near is wholly inside or outside; only the others are parted
    into children, and carry just the edges near them.  Whether a child's centre is inside follows from its
    parent's and the edges between the two.  Rows are dealt anew every few levels, so one large polygon is many
    tasks' work; its size is that of its border.  Equal polygons are filled once.
    """
    members, polygons = shapes(polygons, keys)
    rings = F.concat(F.array("ring"), "holes") if "holes" in polygons.columns else F.array("ring")
    rows = polygons.select("_shape", F.flatten(F.transform(rings, _edges)).alias("edges")).where(F.size("edges") > 0)
    ends = {"w": "array_min(transform(edges, g -> least(g.x1, g.x2)))", "e": "array_max(transform(edges, g -> greatest(g.x1, g.x2)))", "s": "array_min(transform(edges, g -> least(g.y1, g.y2)))", "n": "array_max(transform(edges, g -> greatest(g.y1, g.y2)))"}
    rows = rows.select("_shape", "edges", *(F.expr(v).alias(k) for k, v in ends.items()))
    reach = reach_degrees(0)
    wide = _half_width(reach)
    rows = rows.withColumn("c", F.explode(_base_cells())).withColumn("turn", F.expr("explode(array(-360D, 0D, 360D))"))
    rows = rows.select("_shape", "edges", "c.cell", F.expr("c.x + turn").alias("x"), "c.y", "w", "e", "s", "n")
    rows = rows.where(f"x + {wide} >= w AND x - {wide} <= e AND y + {reach!r}D >= s AND y - {reach!r}D <= n")
    rows = rows.select("_shape", "cell", "x", "y", F.expr(_crossed("x", "(e + 1)", "y")).alias("inside"), _touching(wide, reach).alias("edges"))
    for r in range(res):
        # where no edge is near, all of the cell is as its centre
        rows = rows.where("size(edges) > 0 OR inside")
        if r and r % spread_every == 0:
            rows = rows.repartition("cell", "_shape")
        whole = F.size("edges") == 0
        kids = F.explode(F.when(whole, F.array("cell")).otherwise(cells.children(F.col("cell"), r)))
        rows = rows.select("_shape", "x", "y", "inside", "edges", whole.alias("whole"), kids.alias("cell"))
        rows = rows.withColumn("c", cells.center(F.when(~F.col("whole"), F.col("cell"))))
        place = (F.expr("coalesce(c.lon + 360 * round((x - c.lon) / 360), x)").alias("x"), F.expr("coalesce(c.lat, y)").alias("y"))
        rows = rows.select("_shape", "cell", "inside", "edges", F.col("x").alias("px"), F.col("y").alias("py"), *place)
        # first along the parent's longitude, then along the child's latitude
        inside = F.expr(f"inside != ({_crossed('py', 'y', 'px', turned=True)} != {_crossed('px', 'x', 'y')})")
        reach = reach_degrees(r + 1)
        rows = rows.select("_shape", "cell", "x", "y", inside.alias("inside"), _touching(_half_width(reach), reach).alias("edges"))
    return rows.where("inside").select("_shape", "cell").distinct().join(members, "_shape").select(*keys, "cell").distinct()


def cell_ranges(fill: DataFrame, res: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, low, high: the ids at `res` under the cells of a fill (cells of `res` and coarser), as ranges."""
    own = cells.resolution(F.col("cell"))
    bounds = F.coalesce(*(F.when(own == r, F.struct(low.alias("low"), high.alias("high"))) for r in range(res + 1) for low, high in [cells.child_range(F.col("cell"), r, res)]))
    return fill.select(*keys, bounds.alias("b")).select(*keys, "b.low", "b.high")


def expanded(fill: DataFrame, res: int) -> DataFrame:
    """A fill with its coarser cells replaced by all cells of `res` under them."""
    others = [c for c in fill.columns if c != "cell"]
    for r in range(res):
        own = cells.resolution(F.col("cell")) == r
        fill = fill.select(*others, F.explode(F.when(own, cells.children(F.col("cell"), r)).otherwise(F.array("cell"))).alias("cell"))
    return fill


def polyfill(polygons: DataFrame, res: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """keys, cell: the cells whose centre lies in each polygon (keys, ring, perhaps holes).

    A multipolygon is several rows of one key: its cells are united.
    """
    return expanded(refined(polygons, res, keys), res).distinct()


def fill_report(polygons: DataFrame, res: int) -> DataFrame:
    """id, n_cells, hex_m2, poly_m2, coverage: how the cells of each polygon (id, ring) cover it."""
    filled = polyfill(polygons, res).groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum(cells.area_m2(F.col("cell"))).alias("hex_m2"))
    out = polygons.select("id", geo.ring_area_m2(F.col("ring")).alias("poly_m2")).join(filled, "id", "left")
    out = out.select("id", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("hex_m2", F.lit(0.0)).alias("hex_m2"), "poly_m2")
    return out.withColumn("coverage", F.when(F.col("poly_m2") > 0, F.round(F.col("hex_m2") / F.col("poly_m2"), 4)))


def _cross(o: Column, p: Column, q: Column) -> Column:
    return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])


def _rotated(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))


def clipped(ring: Column, convex: Column) -> Column:
    """A convex ring cut by a convex counter-clockwise one, one half-plane after the other."""
    edges = F.zip_with(convex, _rotated(convex), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def cut(rest: Column, e: Column) -> Column:
        def corners(p: Column, q: Column) -> Column:
            s, t = _cross(e["a"], e["b"], p), _cross(e["a"], e["b"], q)
            k = s / F.when(s == t, F.lit(1.0)).otherwise(s - t)
            at = F.struct((p["x"] + (q["x"] - p["x"]) * k).alias("x"), (p["y"] + (q["y"] - p["y"]) * k).alias("y"))
            return F.filter(F.array(F.when(s >= 0, p), F.when((s >= 0) != (t >= 0), at)), lambda x: x.isNotNull())

        return F.flatten(F.zip_with(rest, _rotated(rest), corners))

    return F.aggregate(edges, ring, cut)


def fan(polygons: DataFrame, key: str, name: str) -> DataFrame:
    """key, name: counter-clockwise triangles (array of three corners) from each ring's first corner, and name_sign,
    -1 where the ring runs the other way there: with their signs they add up to the polygon, convex or not."""
    ring = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    rows = polygons.where(F.size("ring") >= 3).select(key, ring.alias("_r")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_r") - 2)))
    o, p, q = F.col("_r")[0], F.get("_r", F.col("_i")), F.get("_r", F.col("_i") + 1)
    rows = rows.select(key, o.alias("_o"), p.alias("_p"), q.alias("_q"), F.signum(_cross(o, p, q)).alias(f"{name}_sign")).where(F.col(f"{name}_sign") != 0)
    left = F.col(f"{name}_sign") > 0
    return rows.select(key, f"{name}_sign", F.array("_o", F.when(left, F.col("_p")).otherwise(F.col("_q")), F.when(left, F.col("_q")).otherwise(F.col("_p"))).alias(name))


def overlay(polygons: DataFrame, within: DataFrame, step: float = 5.0) -> DataFrame:
    """id, other, area_m2: the area that polygons (id, ring) share with those of `within` (id, ring), where they do.

    Triangles of both sides meet in tiles of `step` degrees (a pair counts in the tile of its boxes' corner) and are
    cut by each other; signed, their areas add up to that of the polygons' pieces.  Areas are planar at the middle
    latitude of the polygon's triangle.  Equal polygons are cut once; their pairs are joined to the areas at the end.
    """
    sides, members = [], []
    for df, key, name in ((polygons, "id", "a"), (within.withColumnRenamed("id", "other"), "other", "b")):
        own, df = shapes(df.select(key, "ring"), [key])
        members.append(own.withColumnRenamed("_shape", f"_{name}"))
        df = df.withColumnRenamed("_shape", f"_{name}")
        x, y = F.transform(name, lambda p: p["x"]), F.transform(name, lambda p: p["y"])
        box = {f"{name}_w": F.array_min(x), f"{name}_e": F.array_max(x), f"{name}_s": F.array_min(y), f"{name}_n": F.array_max(y)}
        tiles = lambda lo, hi, name=name: F.explode(F.sequence(F.floor(F.col(f"{name}_{lo}") / step), F.floor(F.col(f"{name}_{hi}") / step)))
        sides.append(fan(df, f"_{name}", name).withColumns(box).withColumn("_x", tiles("w", "e")).withColumn("_y", tiles("s", "n")))
    near = sides[0].join(sides[1], ["_x", "_y"])
    meet = (F.col("a_w") <= F.col("b_e")) & (F.col("b_w") <= F.col("a_e")) & (F.col("a_s") <= F.col("b_n")) & (F.col("b_s") <= F.col("a_n"))
    corner = (F.floor(F.greatest("a_w", "b_w") / step) == F.col("_x")) & (F.floor(F.greatest("a_s", "b_s") / step) == F.col("_y"))
    pieces = near.where(meet & corner).withColumn("piece", clipped(F.col("a"), F.col("b")))
    pairs = F.zip_with("piece", _rotated(F.col("piece")), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    twice = F.aggregate(pairs, F.lit(0.0), lambda t, v: t + v)
    metres = math.radians(1) * geo.EARTH_KM * 1000
    scale = metres * metres * F.cos(F.radians((F.col("a_s") + F.col("a_n")) / 2))
    sums = graph.cut(pieces.groupBy("_a", "_b").agg(F.sum(F.col("a_sign") * F.col("b_sign") * twice / 2 * scale).alias("_m2")).where("_m2 <> 0"))
    sums = sums.join(members[0], "_a").join(members[1], "_b").groupBy("id", "other").agg(F.sum("_m2").alias("_m2"))
    # a pair that only touches leaves a rest of rounding
    return sums.select("id", "other", F.abs("_m2").alias("area_m2")).where("area_m2 > 1e-3")


def carried_mean(polygons: DataFrame, within: DataFrame, res: int, value: str) -> DataFrame:
    """cell, mean, n, area_mean: polygons (id, ring, value) cut by the areas of `within` (id, ring), the pieces filled
    with cells, and each cell's mean of the values it gets, plain and weighted by the area of the pieces.

    A cell's centre lies in the cut of two polygons if it lies in both, so that the cut itself only gives the areas.
    """
    known = polygons.where(F.col(value).isNotNull())
    inside = polyfill(within, res).select("cell").distinct()
    own = polyfill(known.select("id", "ring"), res).join(inside, "cell", "left_semi")
    areas = overlay(known.select("id", "ring"), within.select("id", "ring")).groupBy("id").agg(F.sum("area_m2").alias("_m2"))
    values = known.groupBy("id").agg(F.first(value).alias(value)).join(areas, "id", "left")
    weight = F.coalesce("_m2", F.lit(0.0))
    return own.join(values, "id").groupBy("cell").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), (F.sum(F.col(value) * weight) / F.sum(weight)).alias("area_mean"))


def descent(df: DataFrame, res: int, cell: str = "cell") -> DataFrame:
    """cell, pentagon, center, boundary, children (id, pentagon, boundary) of cells of one resolution."""
    own = df.select(F.col(cell).alias("cell")).distinct()
    kids = own.select("cell", F.explode(cells.children(F.col("cell"), res)).alias("id"))
    kids = kids.select("cell", F.struct("id", cells.is_pentagon(F.col("id")).alias("pentagon"), cells.boundary(F.col("id")).alias("boundary")).alias("kid"))
    kids = kids.groupBy("cell").agg(F.sort_array(F.collect_list("kid")).alias("children"))  # seven at most
    c = F.col("cell")
    return own.select("cell", cells.is_pentagon(c).alias("pentagon"), cells.center(c).alias("center"), cells.boundary(c).alias("boundary")).join(kids, "cell")


def area_drift(df: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, res, m2, drift: each cell's area over the mean of its resolution's cells in the table."""
    own = df.select(F.col(cell).alias("cell")).distinct().withColumn("res", cells.resolution(F.col("cell"))).withColumn("m2", cells.area_m2(F.col("cell")))
    mean = own.groupBy("res").agg(F.avg("m2").alias("_mean"))
    return own.join(F.broadcast(mean), "res").select("cell", "res", "m2", (F.col("m2") / F.col("_mean")).alias("drift"))


#: Ranges of ids that a scan is cut to at most (never fewer than the base cells).
RANGES = 128


def covering_ranges(parents: DataFrame, parent_res: int, res: int) -> list[tuple[int, int]]:
    """The ids at `res` under the cells of `parents` (parent) as at most RANGES ranges: those of the finest
    resolution that has so few cells over them, neighbours joined."""
    column = lambda r: cells.parent(F.col("parent"), r)
    known = parents.where("parent is not null").select("parent").distinct()
    counts = known.agg(*(F.count_distinct(column(r)) for r in range(parent_res + 1))).first()
    at = max(r for r in range(parent_res + 1) if counts[r] <= RANGES)
    low, high = cells.child_range(F.col("at"), at, res)
    rows = known.select(column(at).alias("at")).distinct().select(low.alias("low"), high.alias("high")).collect()  # RANGES at most
    out: list[tuple[int, int]] = []
    unit = cells.span(res)
    for a, b in sorted((r["low"], r["high"]) for r in rows):
        if out and a <= out[-1][1] + unit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def under(df: DataFrame, cell: str, parents: DataFrame, parent_res: int, res: int) -> DataFrame:
    """The rows whose cell (of `res`) lies under one of the cells of `parents` (parent).

    Ids under a cell are one range, so the scan is first cut to a few ranges: on a table sorted by cell it skips the
    files and row groups outside and between them.  The cells of `parents` are looked at when the query is built.
    """
    ranges = covering_ranges(parents, parent_res, res)
    if not ranges:
        return df.limit(0)
    near = df.where(functools.reduce(operator.or_, (F.col(cell).between(F.lit(a), F.lit(b)) for a, b in ranges)))
    return near.withColumn("parent", cells.parent(F.col(cell), parent_res)).join(parents.select("parent").distinct(), "parent", "left_semi").drop("parent")


def mismatch(df: DataFrame, cell: str = "cell") -> DataFrame:
    """cell, parent_m2, children_m2, leak_pct, gap_pct, area_ratio, twist_deg: how badly the children tile each cell.

    Areas are planar in the equidistant projection around the cell's centre.  leak: the part of the children outside
    the parent; gap: the part of the parent outside the children; twist: the turn of the middle child against the
    parent, for hexagons with six corners.
    """
    kind = "struct<parent_m2: double, children_m2: double, leak_pct: double, gap_pct: double, area_ratio: double, twist_deg: double>"

    @F.pandas_udf(kind)
    def run(ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_mismatch(int(c)) for c in ids], columns=["parent_m2", "children_m2", "leak_pct", "gap_pct", "area_ratio", "twist_deg"])

    # ids are few bytes for much work: a number of partitions of our own, as adaptive execution would make one of them
    own = df.select(F.col(cell).alias("cell")).distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return own.select("cell", run("cell").alias("m")).select("cell", "m.*")


def _children(cell: int) -> np.ndarray:
    res = (cell >> 52) & 15
    head = (cell & ~(15 << 52) & ~(7 << 3 * (14 - res))) | ((res + 1) << 52)
    kids = [head | (d << 3 * (14 - res)) for d in range(7)]
    pentagon = (cell >> 45) & 127 in cells.PENTAGONS and not cell & ((1 << 45) - (1 << 3 * (15 - res)))
    return np.array([k for d, k in enumerate(kids) if not (pentagon and d == 1)], np.int64)


def _flat(ring: np.ndarray, lat: float, lon: float) -> np.ndarray:
    """A ring of the sphere in the equidistant projection around a point, counter-clockwise."""
    c = hexgrid.unit_vector(np.radians(lat), np.radians(lon))
    east = np.array([-np.sin(np.radians(lon)), np.cos(np.radians(lon)), 0.0])
    x, y, z = ring @ east, ring @ np.cross(c, east), ring @ c
    far = np.arctan2(np.hypot(x, y), z) / np.maximum(np.hypot(x, y), 1e-15) * geo.AUTHALIC_M
    out = np.stack([x * far, y * far], 1)
    return out if _signed(out) >= 0 else out[::-1]


def _signed(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2


def _cut(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """A polygon cut by a convex counter-clockwise one, one half-plane after the other."""
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if not len(subject):
            break
        side = (b[0] - a[0]) * (subject[:, 1] - a[1]) - (b[1] - a[1]) * (subject[:, 0] - a[0])
        out = []
        for p, q, s, t in zip(subject, np.roll(subject, -1, axis=0), side, np.roll(side, -1)):
            if s >= 0:
                out.append(p)
            if (s >= 0) != (t >= 0):
                out.append(p + (q - p) * (s / (s - t)))
        subject = np.array(out).reshape(-1, 2)
    return subject


def _orientation(p: np.ndarray, n: int) -> float:
    d = p - p.mean(0)
    a = np.arctan2(d[:, 1], d[:, 0]) * n
    return float(np.degrees(np.arctan2(np.sin(a).sum(), np.cos(a).sum()))) / n


def _mismatch(cell: int) -> tuple:
    lat, lon = (float(x[0]) for x in hexgrid.center_of(np.array([cell])))
    parent = _flat(hexgrid.boundary_of(np.array([cell]))[0], lat, lon)
    kids = [_flat(r, lat, lon) for r in hexgrid.boundary_of(_children(cell))]
    whole, total, middle = abs(_signed(parent)), sum(abs(_signed(k)) for k in kids), parent.mean(0)
    # cells near pentagons are not quite convex: the parent is cut into triangles around its middle
    fan = [np.array([middle, p, q]) for p, q in zip(parent, np.roll(parent, -1, axis=0))]
    inside = sum(abs(_signed(c)) for k in kids for t in fan if len(c := _cut(k, t if _signed(t) >= 0 else t[::-1])))
    central = min(kids, key=lambda k: float((k.mean(0) ** 2).sum()))
    twist = None
    if len(parent) == 6 and len(central) == 6 and len(kids) == 7:
        d = (_orientation(central, 6) - _orientation(parent, 6)) % 60
        twist = round(d - 60 if d > 30 else d, 2)
    return round(whole, 1), round(total, 1), round((total - inside) / total * 100, 3), round((whole - inside) / whole * 100, 3), round(total / whole, 4), twist
