"""Queries over hex cells: bit functions, roll-ups, zonal joins, release differences."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as F

from ..functions import cells
from ..operators import aggregates as agg
from ..operators import joins
from .fixtures import PIXELS, PTS, parent_sql, pixels, points
from .registry import query, table

P5, P6 = parent_sql("cell", 5), parent_sql("cell", 6)


@query("hex_bits", f"""WITH {PTS} SELECT id, cell, ((cell >> 52) & 15)::INT AS res, {P6} AS parent6, {parent_sql('cell', 0)} AS parent0,
  lower(hex(cell)) AS text, ({P6} & {~(15 << 52)} | {8 << 52}) & {~(((1 << 27) - 1) ^ ((1 << 21) - 1))} AS low, ({P6} & {~(15 << 52)} | {8 << 52}) AS high FROM pts""")
def hex_bits(spark, sf):
    c = F.col("cell")
    low, high = cells.child_range(cells.parent(c, 6), 6, 8)
    return points(spark, sf).select("id", "cell", cells.resolution(c).alias("res"), cells.parent(c, 6).alias("parent6"), cells.parent(c, 0).alias("parent0"), cells.to_text(c).alias("text"), low.alias("low"), high.alias("high"))


@query("hex_children", f"""WITH {PTS}, p AS (SELECT DISTINCT {parent_sql('cell', 7)} AS cell FROM pts)
  SELECT cell, (cell & {~(15 << 52) & ~(7 << 21)}) | {8 << 52} | (d << 21) AS child FROM p, (SELECT unnest(range(7)) AS d)""")
def hex_children(spark, sf):
    p = points(spark, sf).select(cells.parent(F.col("cell"), 7).alias("cell")).distinct()
    return p.select("cell", F.explode(cells.children(F.col("cell"), 7)).alias("child"))


_PENT = "(4,14,24,38,49,58,63,72,83,97,107,117)"


@query("hex_pentagons", f"""WITH r AS (SELECT p_partkey AS id, p_partkey % 4 AS res, p_partkey % 122 AS base, p_partkey // 500 AS digit FROM part),
  c AS (SELECT id, res, base, {1 << 59} | (res << 52) | (base << 45) | ({(1 << 45) - 1} >> (3 * res)) | CASE WHEN res > 0 THEN digit % 7 * (1 << (45 - 3 * res)) ELSE 0 END AS cell, digit FROM r)
  SELECT id, cell, base IN {_PENT} AND (res = 0 OR digit % 7 = 0) AS pentagon FROM c""")
def hex_pentagons(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey % 4 AS res", "p_partkey % 122 AS base", "p_partkey div 500 AS digit")
    cell = F.expr(f"{1 << 59} | shiftleft(res, 52) | shiftleft(base, 45) | shiftright({(1 << 45) - 1}L, cast(3 * res AS int)) | CASE WHEN res > 0 THEN digit % 7 * shiftleft(1L, cast(45 - 3 * res AS int)) ELSE 0 END")
    return rows.select("id", cell.alias("cell")).select("id", "cell", cells.is_pentagon(F.col("cell")).alias("pentagon"))


@query("hex_resolution_for_area", f"WITH {PTS} SELECT id, CASE WHEN abs(elev) * 5 <= 120 THEN 9 WHEN abs(elev) * 5 <= 900 THEN 8 ELSE 7 END AS res FROM pts")
def hex_resolution_for_area(spark, sf):
    return points(spark, sf).select("id", cells.resolution_for_area(F.abs("elev") * 5).alias("res"))


@query("hexify", f"WITH {PTS} SELECT {P6} AS parent, sum(cents) AS total, count(*) AS n FROM pts GROUP BY 1")
def hexify(spark, sf):
    return agg.hexify(points(spark, sf).withColumn("parent", cells.parent(F.col("cell"), 6)), "parent", F.col("cents"))


@query("raster_hexify", f"""WITH {PIXELS} SELECT row // 8 * 16 + col // 8 AS cell, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n,
  array_to_string(list_sort(list(row * 128 + col)), ',') AS members FROM pixels GROUP BY 1""")
def raster_hexify(spark, sf):
    px = pixels(spark, sf).withColumn("cell", F.expr("row div 8 * 16 + col div 8")).withColumn("index", F.expr("row * 128 + col"))
    return agg.raster_hexify(px, "cell", "value", "index").withColumn("mean", F.round("mean", 6)).withColumn("members", F.array_join("members", ","))


@query("roll_up_parent", f"""WITH {PTS} SELECT {P5} AS parent, sum(greatest(cents, 0)) AS pop,
  round(CASE WHEN sum(greatest(cents, 0)) > 0 THEN sum(elev * greatest(cents, 0)) / sum(greatest(cents, 0)) ELSE avg(elev) END, 6) AS elev, count(*) AS n FROM pts GROUP BY 1""")
def roll_up_parent(spark, sf):
    base = points(spark, sf).withColumn("pop", F.greatest("cents", F.lit(0)))
    return agg.roll_up(base, "cell", 5, "pop", "elev").withColumn("elev", F.round("elev", 6))


@query("multi_resolution", " UNION ALL ".join(f"SELECT {r} AS res, {parent_sql('cell', r)} AS parent, sum(cents) AS total, count(*) AS n FROM (WITH {PTS} SELECT * FROM pts) GROUP BY 2" for r in (3, 5, 7)))
def multi_resolution(spark, sf):
    return agg.multi_resolution(points(spark, sf), "cell", (3, 5, 7), F.col("cents"))


@query("sketched_cells", " UNION ALL ".join(f"SELECT {r} AS res, {parent_sql('cell', r)} AS parent, count(*) AS n, count(DISTINCT id) AS ids, true AS distinct_fits, true AS ranks_fit FROM (WITH {PTS} SELECT * FROM pts) GROUP BY 2" for r in (4, 5, 6)))
def sketched_cells(spark, sf):
    """Sketches of cells merged to three resolutions, beside the exact figures: whether they keep what they promise."""
    pts = points(spark, sf).select("id", "cell", F.col("cents").cast("double").alias("v"))
    found = agg.sketched_stats(agg.merged_sketches(agg.cell_sketches(pts, "cell", "v", "id"), (4, 5, 6)))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("res"), cells.parent(F.col("cell"), r).alias("parent")) for r in (4, 5, 6))))
    rows = pts.select("id", "v", each.alias("x")).select("id", "v", "x.*").join(found, ["res", "parent"])
    at = (0.02, 0.5, 0.98)
    below = [F.count_if(F.col("v") < F.col("q")[i]) for i in range(3)] + [F.count_if(F.col("v") <= F.col("q")[i]) for i in range(3)]
    exact = rows.groupBy("res", "parent", "n", "distinct").agg(F.count_distinct("id").alias("ids"), *(c.alias(f"b{i}") for i, c in enumerate(below)))
    off = 3 * agg.KLL_RANK_ERROR
    fits = functools.reduce(operator.and_, ((F.col(f"b{i}") <= (t + off) * F.col("n") + 1) & (F.col(f"b{i + 3}") >= (t - off) * F.col("n") - 1) for i, t in enumerate(at)))
    return exact.select("res", "parent", "n", "ids", (F.abs(F.col("distinct") - F.col("ids")) <= agg.HLL_ERROR * F.col("ids")).alias("distinct_fits"), fits.alias("ranks_fit"))


_ZONES = f"""WITH {PTS}, elev AS (SELECT cell, avg(elev) AS elev FROM pts GROUP BY 1), pop AS (SELECT cell, sum(cents) AS pop FROM pts WHERE nation % 3 <> 0 GROUP BY 1),
  base AS (SELECT e.cell, e.elev, coalesce(p.pop, 0) AS pop FROM elev e LEFT JOIN pop p USING (cell))"""
_EDGES = (None, 0.0, 10.0, 50.0, 100.0, 200.0, 5000.0, None)


def _zones(spark, sf):
    pts = points(spark, sf)
    elev = pts.groupBy("cell").agg(F.avg("elev").alias("elev"))
    pop = pts.where("nation % 3 <> 0").groupBy("cell").agg(F.sum("cents").alias("pop"))
    return elev.join(pop, "cell", "left").withColumn("pop", F.coalesce("pop", F.lit(0)))


@query("zonal_bands", f"""{_ZONES}, bands AS (SELECT unnest(range(7))::INT AS band), b AS (SELECT CASE WHEN elev < 0 THEN 0 WHEN elev < 10 THEN 1 WHEN elev < 50 THEN 2 WHEN elev < 100 THEN 3 WHEN elev < 200 THEN 4 WHEN elev < 5000 THEN 5 ELSE 6 END AS band, pop FROM base)
  SELECT bands.band, coalesce(sum(pop), 0)::BIGINT AS total, count(pop) AS n FROM bands LEFT JOIN b USING (band) GROUP BY 1""")
def zonal_bands(spark, sf):
    """Elevation cells left-joined with population cells, totals by elevation band."""
    return agg.banded(_zones(spark, sf), "elev", "pop", _EDGES)


@query("zonal_below", f"{_ZONES} SELECT sum(pop)::BIGINT AS total, sum(CASE WHEN elev < 10 THEN pop END)::BIGINT AS below, round(100.0 * sum(CASE WHEN elev < 10 THEN pop END) / sum(pop), 6) AS percent FROM base")
def zonal_below(spark, sf):
    below = F.sum(F.when(F.col("elev") < 10, F.col("pop")))
    return _zones(spark, sf).agg(F.sum("pop").alias("total"), below.alias("below"), F.round(F.try_divide(below * 100, F.sum("pop")), 6).alias("percent"))


@query("cell_membership", f"WITH {PTS} SELECT id, cell FROM pts WHERE {P5} IN (SELECT {P5} FROM pts WHERE nation = 7)")
def cell_membership(spark, sf):
    pts = points(spark, sf).withColumn("p5", cells.parent(F.col("cell"), 5))
    return pts.join(pts.where("nation = 7").select("p5").distinct(), "p5", "left_semi").select("id", "cell")


_D = "date '1995-06-17'"


@query("release_diff", f"""WITH o AS (SELECT l_partkey // 7 AS cell, count(*) AS before FROM lineitem WHERE l_shipdate < {_D} GROUP BY 1), n AS (SELECT l_partkey // 7 AS cell, count(*) AS after FROM lineitem WHERE l_shipdate >= {_D} GROUP BY 1)
  SELECT cell, coalesce(before, 0) AS before, coalesce(after, 0) AS after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n USING (cell)""")
def release_diff(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.expr("l_partkey div 7").alias("cell"), "l_shipdate")
    count = lambda df: df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return joins.release_diff(count(rows.where(F.col("l_shipdate") < F.expr(_D))), count(rows.where(F.col("l_shipdate") >= F.expr(_D))), "cell", "n")


@query("release_totals", f"SELECT CASE WHEN l_shipdate < {_D} THEN 'old' ELSE 'new' END AS release, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY 1")
def release_totals(spark, sf):
    release = F.when(F.col("l_shipdate") < F.expr(_D), "old").otherwise("new")
    return table(spark, sf, "lineitem").groupBy(release.alias("release")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
