"""Queries over graphs and flood grids (iterative DataFrame plans)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flood, graph
from .registry import query, table

# a tree over parts (i to i div 2) with chords to i div 7, costs 1 + i % 5
_EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, 1 + p_partkey % 5 AS cost FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 7, 2 + p_partkey % 3 FROM part WHERE p_partkey >= 7), d AS (SELECT src, dst, cost FROM e UNION ALL SELECT dst, src, cost FROM e)"
_REACH = f"""WITH RECURSIVE {_EDGES}, r AS (SELECT 1::BIGINT AS node, 0::BIGINT AS cost UNION SELECT d.dst, r.cost + d.cost FROM r JOIN d ON d.src = r.node WHERE d.dst > r.node)
  SELECT node, min(cost)::DOUBLE AS cost FROM r GROUP BY 1"""


def _edges(spark, sf, both=True):
    p = table(spark, sf, "part").selectExpr("p_partkey AS k")
    up = p.where("k > 1").selectExpr("k AS src", "k div 2 AS dst", "1 + k % 5 AS cost").unionByName(p.where("k >= 7").selectExpr("k AS src", "k div 7 AS dst", "2 + k % 3 AS cost"))
    down = up.selectExpr("dst AS src", "src AS dst", "cost")
    return up.unionByName(down) if both else down


def _start(spark, sf, where="p_partkey = 1"):
    return table(spark, sf, "part").where(where).selectExpr("p_partkey AS node", "0D AS cost", "p_partkey AS label")


@query("travel_times", _REACH)
def travel_times(spark, sf):
    """Cheapest costs from node 1 along edges away from it."""
    return graph.shortest(_edges(spark, sf, both=False), _start(spark, sf)).select("node", "cost")


@query("reach_by_group", f"WITH t AS ({_REACH}) SELECT node % 25 AS grp, min(cost) AS cost FROM t GROUP BY 1")
def reach_by_group(spark, sf):
    paths = graph.shortest(_edges(spark, sf, both=False), _start(spark, sf))
    return graph.reach_by_group(paths, paths.select("node", (F.col("node") % 25).alias("grp"))).select("grp", "cost")


_LABELS = f"""{_EDGES}, t(node, cost, label) USING KEY (node) AS (SELECT p_partkey, 0::DOUBLE, p_partkey FROM part WHERE p_partkey % 500 = 1
  UNION (SELECT d.dst, min(t.cost + d.cost), arg_min(t.label, (t.cost + d.cost, t.label)) FROM t JOIN d ON d.src = t.node LEFT JOIN recurring.t AS r ON r.node = d.dst WHERE r.node IS NULL OR (t.cost + d.cost, t.label) < (r.cost, r.label) GROUP BY 1))"""


@query("nearest_source_labels", f"WITH RECURSIVE {_LABELS} SELECT node, cost, label FROM t")
def nearest_source_labels(spark, sf):
    """Every node's nearest source over both directions, cost and label (tests compare with a heap)."""
    return graph.shortest(_edges(spark, sf), _start(spark, sf, "p_partkey % 500 = 1")).select("node", "cost", "label")


@query("label_borders", f"WITH RECURSIVE {_LABELS} SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, min(p.cost + d.cost + q.cost) AS cost FROM d JOIN t p ON p.node = d.src JOIN t q ON q.node = d.dst WHERE p.label <> q.label GROUP BY 1, 2")
def label_borders(spark, sf):
    e = _edges(spark, sf)
    return graph.label_borders(graph.shortest(e, _start(spark, sf, "p_partkey % 500 = 1")), e)


@query("rides", f"""WITH RECURSIVE {_LABELS}, b AS (SELECT least(p.label, q.label) AS a, greatest(p.label, q.label) AS b, min(p.cost + d.cost + q.cost) AS km FROM d JOIN t p ON p.node = d.src JOIN t q ON q.node = d.dst WHERE p.label <> q.label GROUP BY 1, 2)
  SELECT a, b, round(km / [150, 55, 32, 45, 20][a // 500 % 5 + 1] * 60 + [1.0, 0.7, 0.6, 0.7, 0.5][a // 500 % 5 + 1]::DOUBLE, 2) AS minutes, round(km, 3) AS km FROM b""")
def rides(spark, sf):
    """Rides between neighbouring sources, at the speed of the first one's category."""
    e = _edges(spark, sf)
    borders = graph.label_borders(graph.shortest(e, _start(spark, sf, "p_partkey % 500 = 1")), e)
    stations = table(spark, sf, "part").where("p_partkey % 500 = 1").selectExpr("p_partkey AS label", "cast(p_partkey div 500 % 5 AS int) AS category")
    return graph.rides(borders, stations)


@query("connected_parts", """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 AND p_partkey % 16 <> 0), n AS (SELECT p_partkey AS node FROM part), r AS (SELECT node, node AS top FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.top = e.a) SELECT node, min(top) AS component FROM r GROUP BY 1""")
def connected_parts(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey AS node")
    edges = p.where("node > 1 AND node % 16 <> 0").selectExpr("node AS a", "node div 2 AS b")
    return graph.connected(edges, p)


def _grid(spark, sf):
    """One cell per part, 40 to a row; heights by formula."""
    return table(spark, sf, "part").selectExpr("cast((p_partkey - 1) div 40 AS int) AS row", "cast((p_partkey - 1) % 40 AS int) AS col", "cast((p_partkey * p_partkey * 31 + p_partkey * 17) % 97 AS double) / 10 AS elev")


_G = "g AS (SELECT ((p_partkey - 1) // 40)::INT AS row, ((p_partkey - 1) % 40)::INT AS col, ((p_partkey * p_partkey * 31 + p_partkey * 17) % 97)::DOUBLE / 10 AS elev FROM part)"


@query("flood_levels", f"""WITH RECURSIVE {_G}, t(row, col, level) USING KEY (row, col) AS (SELECT row, col, elev FROM g WHERE col = 0
  UNION (SELECT g.row, g.col, min(greatest(t.level, g.elev)) FROM t JOIN g ON abs(g.row - t.row) + abs(g.col - t.col) = 1 LEFT JOIN recurring.t AS r ON r.row = g.row AND r.col = g.col WHERE r.row IS NULL OR greatest(t.level, g.elev) < r.level GROUP BY 1, 2)) SELECT row, col, level FROM t""")
def flood_levels(spark, sf):
    """The lowest water level that reaches each cell from the west edge (tests compare with a heap)."""
    g = _grid(spark, sf)
    return flood.flood_levels(g, g.where("col = 0"))


@query("sea_water", f"""WITH RECURSIVE {_G}, w AS (SELECT row, col, row * 40 + col AS id FROM g WHERE elev < 7), t(row, col, top) USING KEY (row, col) AS (SELECT row, col, id FROM w
  UNION (SELECT w.row, w.col, min(t.top) FROM t JOIN w ON abs(w.row - t.row) + abs(w.col - t.col) = 1 JOIN recurring.t AS r ON r.row = w.row AND r.col = w.col WHERE t.top < r.top GROUP BY 1, 2)),
  p AS (SELECT top FROM t GROUP BY 1 HAVING count(*) >= 4 AND bool_or(col = 0)) SELECT row, col FROM t WHERE top IN (SELECT top FROM p)""")
def sea_water(spark, sf):
    g = _grid(spark, sf)
    return flood.sea_water(g.where("elev < 7"), g.where("col = 0"), 4)


@query("dilated", f"WITH {_G}, w AS (SELECT row, col FROM g WHERE elev < 0.3), s AS (SELECT a::INT AS a, b::INT AS b FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE abs(a) + abs(b) <= 3) SELECT DISTINCT row + a AS row, col + b AS col FROM w, s")
def dilated(spark, sf):
    return flood.dilated(_grid(spark, sf).where("elev < 0.3"), 3)


@query("bank_heights", f"WITH {_G} SELECT w.row, w.col, arg_min(l.elev, (pow(w.row - l.row, 2) + pow(w.col - l.col, 2), l.elev)) AS bank FROM g w, g l WHERE w.elev < 5 AND l.elev >= 5 GROUP BY 1, 2")
def bank_heights(spark, sf):
    g = _grid(spark, sf)
    return flood.nearest_land(g, g.where("elev < 5"), 12)


@query("way_back", """WITH RECURSIVE e AS (SELECT p_partkey AS k FROM part), r AS (SELECT k AS target, 0 AS hop, k AS node FROM e WHERE k % 50 = 7 UNION ALL SELECT target, hop + 1, node // 2 FROM r WHERE node > 1) SELECT target, hop, node FROM r""")
def way_back(spark, sf):
    """Paths to some parts, traced back to node 1 along a tree."""
    p = table(spark, sf, "part").where("p_partkey > 1").selectExpr("p_partkey div 2 AS src", "p_partkey AS dst", "1 AS cost")
    paths = graph.shortest(p, _start(spark, sf))
    return graph.trace(paths, paths.where("node % 50 = 7").select("node"))
