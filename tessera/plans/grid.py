"""Queries over the hexagon grid's geometry: points to cells, boundaries, fills, neighbours, areas."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import cells, geo
from ..operators import hexes
from .fixtures import PTS, parent_sql, points
from .registry import query, table


def zones(spark, sf):
    """id, ring: a triangle of some degrees for each supplier."""
    z = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "cast(s_suppkey * 7919 % 1200 AS double) / 10 - 60 AS x", "cast(s_suppkey * 104729 % 800 AS double) / 10 - 40 AS y")
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    return z.select("id", F.array(corner(0.0, 0.0), corner(3.0, 0.0), corner(0.0, 4.0)).alias("ring"))


@query("cells_of_points", None)
def cells_of_points(spark, sf):
    """Each point's cell at resolution 9, in the order of the points."""
    return hexes.indexed(points(spark, sf).select("id", "lat", "lon"), 9).select("id", "cell")


@query("cell_round_trip", f"WITH {PTS} SELECT id, cell, cell AS again, {parent_sql('cell', 7)} AS coarse, {parent_sql('cell', 7)} AS coarse_again FROM pts")
def cell_round_trip(spark, sf):
    """A cell's centre lies in the cell, at even and odd resolutions."""
    rows = points(spark, sf).select("id", "cell", cells.parent(F.col("cell"), 7).alias("coarse"))
    rows = rows.withColumn("a", cells.center(F.col("cell"))).withColumn("b", cells.center(F.col("coarse")))
    return rows.select("id", "cell", cells.at(F.col("a.lat"), F.col("a.lon"), 8).alias("again"), "coarse", cells.at(F.col("b.lat"), F.col("b.lon"), 7).alias("coarse_again"))


@query("cell_boundaries", f"WITH {PTS} SELECT DISTINCT cell, 7::BIGINT AS points, true AS closed, true AS holds_center FROM pts")
def cell_boundaries(spark, sf):
    """The closed rings of resolution-8 cells: six corners, around their centre."""
    rows = points(spark, sf).select("cell").distinct().withColumn("ring", cells.boundary(F.col("cell"))).withColumn("c", cells.center(F.col("cell")))
    return rows.select("cell", F.size("ring").cast("long").alias("points"), (F.element_at("ring", 1) == F.element_at("ring", -1)).alias("closed"), geo.ring_contains(F.col("ring"), F.col("c.lon"), F.col("c.lat")).alias("holds_center"))


@query("cell_neighbours", f"WITH {PTS} SELECT DISTINCT {parent_sql('cell', 5)} AS cell, 6::BIGINT AS n, 6::BIGINT AS mutual FROM pts")
def cell_neighbours(spark, sf):
    """How many neighbours a cell has, and how many of them have it as theirs."""
    own = points(spark, sf).select(cells.parent(F.col("cell"), 5).alias("cell")).distinct()
    pairs = own.select("cell", F.explode(cells.neighbours(F.col("cell"))).alias("other"))
    back = pairs.withColumn("mutual", F.array_contains(cells.neighbours(F.col("other")), F.col("cell")))
    return back.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("mutual").alias("mutual"))


@query("base_cell_areas", "SELECT count(DISTINCT p_partkey % 122) AS cells, round(4 * pi() * 6371.007180918475 * 6371.007180918475, 1) AS km2 FROM part")
def base_cell_areas(spark, sf):
    """All base cells together are the sphere."""
    base = table(spark, sf, "part").selectExpr("p_partkey % 122 AS base").distinct()
    cell = F.expr(f"{1 << 59} | shiftleft(base, 45) | {(1 << 45) - 1}L")
    return base.select(cell.alias("cell")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(cells.area_m2(F.col("cell"))) / 1e6, 1).alias("km2"))


@query("polygon_cells", None)
def polygon_cells(spark, sf):
    """The resolution-4 cells whose centre lies in each zone (tests compare with all cells of the grid)."""
    return hexes.polyfill(zones(spark, sf), 4)


@query("united_cells", None)
def united_cells(spark, sf):
    """Five zones as the parts of one multipolygon: their cells, united."""
    return hexes.polyfill(zones(spark, sf).select((F.col("id") % 5).alias("id"), "ring"), 4)


@query("fill_report", None)
def fill_report(spark, sf):
    return hexes.fill_report(zones(spark, sf), 4)


@query("overlay_areas", """WITH z AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 1200)::DOUBLE / 10 - 60 AS x, (s_suppkey * 104729 % 800)::DOUBLE / 10 - 40 AS y FROM supplier),
  p AS (SELECT a.id, b.id AS other, a.y, least(1 - (greatest(a.x, b.x) - a.x) / 3 - (greatest(a.y, b.y) - a.y) / 4, 1 - (greatest(a.x, b.x) - b.x) / 3 - (greatest(a.y, b.y) - b.y) / 4) AS t FROM z a JOIN z b ON b.id % 4 = 0)
  SELECT id, other, round(6 * t * t * pow(radians(1) * 6371, 2) * cos(radians(y + 2)), 3) AS km2 FROM p WHERE t > 0.01""")
def overlay_areas(spark, sf):
    """What each zone shares with every fourth one: translated triangles share a smaller one of their shape."""
    z = zones(spark, sf)
    found = hexes.overlay(z, z.where("id % 4 = 0"))
    whole = 6 * (math.radians(1) * geo.EARTH_KM) ** 2
    at = found.join(z.select("id", F.cos(F.radians(F.col("ring")[0]["y"] + 2)).alias("k")), "id")
    return at.where(F.sqrt(F.col("area_m2") / 1e6 / (whole * F.col("k"))) > 0.01).select("id", "other", F.round(F.col("area_m2") / 1e6, 3).alias("km2"))


@query("carried_mean", None)
def carried_mean(spark, sf):
    """Zones with values, cut by every fourth zone: the mean value of each cell."""
    z = zones(spark, sf)
    return hexes.carried_mean(z.withColumn("income", F.when(F.col("id") % 7 > 0, F.col("id") * 1000)), z.where("id % 4 = 0"), 4, "income")


@query("cell_descent", None)
def cell_descent(spark, sf):
    """Resolution-5 cells with their boundaries and those of their children."""
    rows = hexes.descent(points(spark, sf).select(cells.parent(F.col("cell"), 5).alias("cell")), 5)
    return rows.select("cell", "pentagon", "center", "boundary", "children")


@query("cell_mismatch", None)
def cell_mismatch(spark, sf):
    return hexes.mismatch(points(spark, sf).select(cells.parent(F.col("cell"), 6).alias("cell")))


@query("cell_area_drift", None)
def cell_area_drift(spark, sf):
    own = points(spark, sf).select(F.explode(F.array(cells.parent(F.col("cell"), 3), cells.parent(F.col("cell"), 5))).alias("cell"))
    return hexes.area_drift(own)


@query("range_pruned", f"WITH {PTS} SELECT id, cell FROM pts WHERE {parent_sql('cell', 5)} IN (SELECT {parent_sql('cell', 5)} FROM pts WHERE nation = 3)")
def range_pruned(spark, sf):
    """Cells under given parents: first the range of ids, then the exact test."""
    pts = points(spark, sf).select("id", "cell", "nation")
    parents = pts.where("nation = 3").select(cells.parent(F.col("cell"), 5).alias("parent"))
    return hexes.under(pts, "cell", parents, 5, 8).select("id", "cell")


@query("projected", f"""WITH {PTS}, c AS (SELECT id, 6371007.180918475 * acos(greatest(-1, least(1, sin(radians(20)) * sin(radians(lat)) + cos(radians(20)) * cos(radians(lat)) * cos(radians(lon - 30))))) AS far,
    atan2(sin(radians(lon - 30)) * cos(radians(lat)), cos(radians(20)) * sin(radians(lat)) - sin(radians(20)) * cos(radians(lat)) * cos(radians(lon - 30))) AS az FROM pts)
  SELECT id, round(far * sin(az), 2) AS x, round(far * cos(az), 2) AS y FROM c""")
def projected(spark, sf):
    x, y = geo.equidistant(F.lit(20.0), F.lit(30.0), F.col("lat"), F.col("lon"))
    return points(spark, sf).select("id", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


@query("ring_orientations", f"""WITH {PTS}, r AS (SELECT id, unnest([lon, lon + 3 + abs(elev) / 100, lon + 1]) AS x, unnest([lat, lat + 1, lat + 4]) AS y FROM pts), m AS (SELECT id, avg(x) AS cx, avg(y) AS cy FROM r GROUP BY 1)
  SELECT id, round(degrees(atan2(sum(sin(3 * atan2(y - cy, x - cx))), sum(cos(3 * atan2(y - cy, x - cx))))) / 3, 6) AS turn FROM r JOIN m USING (id) GROUP BY 1""")
def ring_orientations(spark, sf):
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(3 + F.abs("elev") / 100, F.lit(1.0)), corner(F.lit(1.0), F.lit(4.0)))
    return points(spark, sf).select("id", F.round(geo.ring_orientation(ring, 3), 6).alias("turn"))
