"""Queries over single records (weather, runways, fleets, brands, settings), axes, snapping and flood exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, records
from ..operators import flood, graph, joins
from .fixtures import PTS, points
from .graphs import _G, _grid
from .registry import query, table


@query("runway_winds", """WITH w AS (SELECT n_nationkey AS field, CASE WHEN n_nationkey % 6 > 0 THEN n_nationkey * 47 % 360 END AS wd, n_nationkey * 3 % 40 AS wk FROM nation),
  e AS (SELECT s_suppkey AS pos, s_nationkey AS field, lpad((s_suppkey * 7 % 18 + 1)::VARCHAR, 2, '0') AS a, lpad((s_suppkey * 7 % 18 + 19)::VARCHAR, 2, '0') AS b FROM supplier),
  x AS (SELECT pos, field, a || '/' || b AS pair, unnest([a, b]) AS ident, unnest([0, 1]) AS i FROM e), h AS (SELECT x.*, ident::INT * 10 % 360 AS heading, coalesce(wk * cos(radians(wd - ident::INT * 10 % 360)), 0.0) AS h, coalesce(abs(wk * sin(radians(wd - ident::INT * 10 % 360))), 0.0) AS c FROM x JOIN w USING (field)),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, pair, pos ORDER BY h DESC, i) AS r FROM h) WHERE r = 1), q AS (SELECT *, round_even(h, 0)::INT AS head_kt, round_even(c, 0)::INT AS cross_kt FROM p), t AS (SELECT *, first_value(pair) OVER (PARTITION BY field ORDER BY head_kt DESC, pos) AS top FROM q)
  SELECT field, pair, ident, heading, head_kt, cross_kt, pair = top AS best FROM t""")
def runway_winds(spark, sf):
    winds = table(spark, sf, "nation").selectExpr("n_nationkey AS field", "CASE WHEN n_nationkey % 6 > 0 THEN n_nationkey * 47 % 360 END AS wind_dir", "n_nationkey * 3 % 40 AS wind_kt")
    runways = table(spark, sf, "supplier").selectExpr("s_nationkey AS field", "concat(lpad(s_suppkey * 7 % 18 + 1, 2, '0'), '/', lpad(s_suppkey * 7 % 18 + 19, 2, '0')) AS pair", "s_suppkey AS at")
    return records.runway_winds(winds, runways, "field")


@query("weather_reports", """WITH r AS (SELECT p_partkey AS id, p_partkey % 101 AS code, CASE p_partkey % 4 WHEN 0 THEN '10+' WHEN 1 THEN (p_size / 4.0)::DECIMAL(8,2)::VARCHAR WHEN 2 THEN 'M1/4' END AS vis, p_size * 7 AS secs FROM part)
  SELECT id, CASE code WHEN 0 THEN 'Clear skies' WHEN 1 THEN 'Mainly clear' WHEN 2 THEN 'Partly cloudy' WHEN 3 THEN 'Overcast' WHEN 45 THEN 'Fog' WHEN 48 THEN 'Depositing rime fog' WHEN 51 THEN 'Light drizzle' WHEN 53 THEN 'Drizzle' WHEN 55 THEN 'Dense drizzle' WHEN 56 THEN 'Freezing drizzle' WHEN 57 THEN 'Freezing drizzle' WHEN 61 THEN 'Light rain' WHEN 63 THEN 'Rain' WHEN 65 THEN 'Heavy rain' WHEN 66 THEN 'Freezing rain' WHEN 67 THEN 'Freezing rain' WHEN 71 THEN 'Light snow' WHEN 73 THEN 'Snow' WHEN 75 THEN 'Heavy snow' WHEN 77 THEN 'Snow grains' WHEN 80 THEN 'Light showers' WHEN 81 THEN 'Showers' WHEN 82 THEN 'Violent showers' WHEN 85 THEN 'Snow showers' WHEN 86 THEN 'Snow showers' WHEN 95 THEN 'Thunderstorm' WHEN 96 THEN 'Thunderstorm, hail' WHEN 99 THEN 'Thunderstorm, heavy hail' END AS sky,
  round_even(try_cast(nullif(regexp_extract(vis, '^([0-9.]+)', 1), '') AS DOUBLE) * 1.609::DOUBLE, 0)::INT AS visibility, greatest(round_even((300 - secs)::DOUBLE / 60, 0), 0)::INT AS age FROM r""")
def weather_reports(spark, sf):
    r = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey % 101 AS code", "CASE p_partkey % 4 WHEN 0 THEN '10+' WHEN 1 THEN cast(cast(p_size / 4.0D AS decimal(8,2)) AS string) WHEN 2 THEN 'M1/4' END AS vis", "p_size * 7 AS secs")
    return r.select("id", records.labelled(F.col("code")).alias("sky"), records.visibility_km(F.col("vis")).alias("visibility"), records.age_minutes(F.lit(300), F.col("secs")).alias("age"))


@query("cloud_ceilings", "SELECT l_orderkey AS id, min(l_extendedprice) FILTER (l_returnflag IN ('A', 'R')) AS ceiling FROM lineitem GROUP BY 1")
def cloud_ceilings(spark, sf):
    cover = F.when(F.col("l_returnflag") == "A", "BKN").when(F.col("l_returnflag") == "R", "OVC").otherwise("FEW")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(cover.alias("cover"), F.col("l_extendedprice").alias("base"))).alias("layers"))
    return rows.select("id", records.ceiling(F.col("layers")).alias("ceiling"))


@query("fleet_types", """WITH r AS (SELECT o_orderkey AS id, (o_orderkey * 37 % 14000)::DOUBLE AS km, o_custkey % 5 AS line FROM orders), f AS (SELECT *, CASE line WHEN 0 THEN 500 END AS tp, CASE line WHEN 0 THEN 3000 WHEN 1 THEN 99999 END AS nb, CASE WHEN line = 0 THEN 'AT76' END AS tt, CASE WHEN line IN (0, 2) THEN 'A320' END AS s, 'A321' AS m, CASE WHEN line = 0 THEN 'A359' END AS l, CASE WHEN line IN (0, 1) THEN 'B77W' END AS u FROM r)
  SELECT id, coalesce(CASE WHEN line < 3 THEN CASE WHEN km < coalesce(tp, 0) AND tt IS NOT NULL THEN tt WHEN km < 1200 THEN s WHEN km < least(greatest(coalesce(nb, 0), 1200), 7000) THEN m WHEN km < 7000 THEN coalesce(l, m) ELSE coalesce(u, l, m) END END,
    CASE WHEN km < 1500 THEN 'A320' WHEN km < 3500 THEN 'B738' WHEN km < 9000 THEN 'B789' ELSE 'B77W' END) AS type, floor(km / CASE WHEN line = 0 AND km < 500 THEN 450.0 ELSE 820.0 END::DOUBLE * 60 + 25)::INT AS minutes FROM f""")
def fleet_types(spark, sf):
    r = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "cast(o_orderkey * 37 % 14000 AS double) AS km", "o_custkey % 5 AS line")
    rules = F.when(F.col("line") < 3, F.expr("named_struct('turboprop_below', CASE line WHEN 0 THEN 500 END, 'narrowbody_below', CASE line WHEN 0 THEN 3000 WHEN 1 THEN 99999 END, 'turboprop', CASE WHEN line = 0 THEN 'AT76' END, 'short', CASE WHEN line IN (0, 2) THEN 'A320' END, 'medium', 'A321', 'long', CASE WHEN line = 0 THEN 'A359' END, 'ultra_long', CASE WHEN line IN (0, 1) THEN 'B77W' END)"))
    kind = records.fleet_type(F.col("km"), F.col("rules"))
    return r.withColumn("rules", rules).withColumn("type", kind).select("id", "type", records.flight_minutes(F.col("km"), F.col("type") == "AT76", 820.0, 450.0).alias("minutes"))


@query("line_categories", """SELECT p_partkey AS id, CASE WHEN p_size % 5 = 1 THEN 0 WHEN p_size % 7 IN (1, 2) THEN 4 WHEN p_partkey % 11 = 0 OR p_size % 5 = 3 THEN 2 WHEN p_size % 5 = 2 THEN 1 ELSE 3 END AS category FROM part""")
def line_categories(spark, sf):
    kind, op = (F.col("p_size") % 7).cast("string"), (F.col("p_size") % 5).cast("string")
    name = F.when(F.col("p_partkey") % 11 == 0, F.lit("東西線地下鉄")).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), records.line_category(kind, op, name, F.col("p_brand"), ["1", "2"]).alias("category"))


@query("brands", """WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'STARBUCKS Coffee #' || c_custkey WHEN 1 THEN 'The Mcdonalds on ' || c_mktsegment WHEN 2 THEN c_name || ' #12' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'peet and epoch' END AS name FROM customer)
  SELECT id, CASE WHEN coalesce(name, '') = '' THEN '(unknown)' WHEN id % 6 = 0 THEN 'Starbucks' WHEN id % 6 = 1 THEN 'McDonald' WHEN id % 6 = 2 THEN trim(regexp_replace(name, '#.*$', '')) ELSE 'Epoch' END AS brand FROM r""")
def brands(spark, sf):
    name = F.expr("CASE c_custkey % 6 WHEN 0 THEN concat('STARBUCKS Coffee #', c_custkey) WHEN 1 THEN concat('The Mcdonalds on ', c_mktsegment) WHEN 2 THEN concat(c_name, ' #12') WHEN 3 THEN '' WHEN 5 THEN 'peet and epoch' END")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), records.brand(name).alias("brand"))


@query("category_matches", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 1 OR (p_partkey % 3 = 2 AND p_partkey % 5 > 0 AND p_partkey % 2 = 0)")
def category_matches(spark, sf):
    first = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'parking' WHEN 1 THEN 'National Park' ELSE 'shop' END")
    more = F.expr("CASE WHEN p_partkey % 3 = 2 THEN array(IF(p_partkey % 2 = 0, 'dog_park', 'x'), IF(p_partkey % 5 = 0, 'Parking_lot', 'y')) END")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.struct(first.alias("primary"), more.alias("alternate")).alias("categories"))
    return rows.where(records.in_category(F.col("categories"), "park")).select("id")


@query("large_footprints", f"WITH {PTS} SELECT id FROM pts WHERE (id % 30) / 1e5::DOUBLE * ((id % 20) / 1e5::DOUBLE) >= 100.0 / ((111320.0::DOUBLE * cos(radians((lat + lat + (id % 20) / 1e5::DOUBLE) / 2))) * 111320.0::DOUBLE)")
def large_footprints(spark, sf):
    w, s = F.col("lon"), F.col("lat")
    e, n = (F.col("id") % 30) / F.lit(1e5), (F.col("id") % 20) / F.lit(1e5)
    rows = points(spark, sf).withColumn("e", e).withColumn("n", n)
    return rows.where(records.large_enough(F.lit(0.0), s, F.col("e"), s + F.col("n"), 100.0)).select("id")


@query("nested_paths", """WITH RECURSIVE j AS (SELECT event_id, json_object('a', json_object('k', props::JSON, 'n', event_id % 7), 'b', json_array(1, 'x'), 'c', json_object()) AS v FROM events),
  f AS (SELECT event_id, '' AS path, v FROM j UNION ALL SELECT event_id, CASE WHEN path = '' THEN k ELSE path || '.' || k END, json_extract(v, '$."' || k || '"') FROM (SELECT event_id, path, v, unnest(json_keys(v)) AS k FROM f WHERE json_type(v) = 'OBJECT'))
  SELECT event_id, path, v::VARCHAR AS value FROM f WHERE json_type(v) <> 'OBJECT'""")
def nested_paths(spark, sf):
    text = F.concat(F.lit('{"a":{"k":'), F.col("props"), F.lit(',"n":'), (F.col("event_id") % 7).cast("string"), F.lit('},"b":[1,"x"],"c":{}}'))
    return records.leaf_paths(table(spark, sf, "events").select("event_id", text.alias("settings")), ["event_id"], "settings")


@query("edited_settings", """WITH j AS (SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events)
  SELECT event_id, k AS got, event_id % 9 AS was_set, k AS kept, NULL::BIGINT AS deleted, event_id % 9 AS over_text FROM j""")
def edited_settings(spark, sf):
    """Paths read, set (through what is no object too) and deleted."""
    text = F.concat(F.lit('{"a":{"k":'), F.get_json_object("props", "$.k"), F.lit('},"b":"text"}'))
    rows = table(spark, sf, "events").select("event_id", text.alias("s"), (F.col("event_id") % 9).cast("string").alias("v"))
    rows = rows.withColumn("one", records.json_set(F.col("s"), "a.x.y", F.col("v"))).withColumn("two", records.json_delete(F.col("s"), "a.k")).withColumn("three", records.json_set(F.col("s"), "b.deep", F.col("v")))
    get = lambda c, path, n: records.json_get(F.col(c), path).cast("long").alias(n)
    return rows.select("event_id", get("s", "a.k", "got"), get("one", "a.x.y", "was_set"), get("one", "a.k", "kept"), get("two", "a.k", "deleted"), get("three", "b.deep", "over_text"))


@query("densified_lines", f"""WITH {PTS}, l AS (SELECT id, lon, lat, (id % 40) / 1003.7::DOUBLE AS dx, (id % 25 + 1) / 1009.1::DOUBLE AS dy FROM pts), n AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, greatest(floor(sqrt(dx * dx + dy * dy) / (40.0::DOUBLE / (111320.0::DOUBLE * cos(radians((lat + lat + dy) / 2)))))::INT, 1) AS n FROM l)
  SELECT id, k::INT AS k, round(lon + dx * k / n, 5) AS x, round(lat + dy * k / n, 5) AS y FROM (SELECT *, unnest(range(n + 1)) AS k FROM n)""")
def densified_lines(spark, sf):
    p = points(spark, sf).withColumn("dx", (F.col("id") % 40) / F.lit(1003.7)).withColumn("dy", (F.col("id") % 25 + 1) / F.lit(1009.1))
    at = lambda t: F.struct((F.col("lon") + F.col("dx") * t).alias("x"), (F.col("lat") + F.col("dy") * t).alias("y"))
    lines = p.select("id", F.array(at(0.0), at(0.25), at(1.0)).alias("points"))
    return records.densified(lines)


@query("snapped_points", f"""WITH {PTS}, v AS (SELECT s_nationkey AS line, ((s_suppkey * 7919) % 36000)::DOUBLE / 100 - 180 AS vx, ((s_suppkey * 104729) % 17000)::DOUBLE / 100 - 85 AS vy FROM supplier),
  d AS (SELECT id, vx, vy, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(vy - lat) / 2), 2) + cos(radians(lat)) * cos(radians(vy)) * pow(sin(radians(vx - lon) / 2), 2)))) AS km,
    abs(trunc(vx / 5.0)::BIGINT - trunc(lon / 5.0)::BIGINT) <= 1 AND abs(trunc(vy / 5.0)::BIGINT - trunc(lat / 5.0)::BIGINT) <= 1 AS near FROM pts JOIN v ON line = nation)
  SELECT id, round(arg_min(km, (NOT near, km, vx, vy)), 4) AS km FROM d GROUP BY 1""")
def snapped_points(spark, sf):
    """Each point at the nearest vertex of its own line: a 5-degree grid first."""
    p = points(spark, sf).select("id", F.col("nation").alias("line"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    v = table(spark, sf, "supplier").selectExpr("s_nationkey AS line", "cast((s_suppkey * 7919) % 36000 AS double) / 100 - 180 AS x", "cast((s_suppkey * 104729) % 17000 AS double) / 100 - 85 AS y")
    return joins.snapped(p, v, "line", 5.0).select("id", F.round("km", 4).alias("km"))


@query("gridded_series", f"""WITH {PTS}, a AS (SELECT n_nationkey AS i, n_nationkey * 7.5 - 90.0 AS v FROM nation), o AS (SELECT n_nationkey AS i, n_nationkey * 15.0 AS v FROM nation),
  n AS (SELECT id, (SELECT arg_min(a.i, (abs(a.v - lat), a.v)) FROM a) AS y, (SELECT arg_min(o.i, (abs(o.v - (lon % 360 + 360) % 360), o.v)) FROM o) AS x FROM pts)
  SELECT id, y AS lat_index, x AS lon_index, event_id, value FROM n JOIN (SELECT event_id, value, event_id % 25 AS ey, event_id // 25 % 25 AS ex FROM events) ON ey = y AND ex = x""")
def gridded_series(spark, sf):
    """A series at the grid point nearest to each point; longitudes of the grid run from 0 to 360."""
    axis = lambda e: table(spark, sf, "nation").selectExpr("cast(n_nationkey AS bigint) AS index", f"{e} AS value")
    series = table(spark, sf, "events").selectExpr("event_id", "value", "event_id % 25 AS lat_index", "event_id div 25 % 25 AS lon_index")
    at = joins.nearest_on_axes(points(spark, sf).select("id", "lat", "lon"), {"lat": axis("n_nationkey * 7.5D - 90"), "lon": axis("n_nationkey * 15.0D")}, series)
    return at.select("id", "lat_index", "lon_index", "event_id", "value")


def _flooded(spark, sf):
    g = _grid(spark, sf)
    water = g.where("elev < 3").select("row", "col", F.expr("row % 9 = 4").alias("managed"))
    walls = g.where("col = 20 AND row % 3 = 0").select("row", "col")
    return flood.flood_grid(g, water, walls, g.where("col = 0"), bank_least=1.0, least_cells=3)


#: Water clamped, walls burnt, the sea's parts, banks of canals, the band beside open water, and levels; `f` is the result.
_FLOODED = f"""{_G}, c AS (SELECT row, col, CASE WHEN col = 20 AND row % 3 = 0 THEN 20.0::DOUBLE WHEN elev < 3 THEN least(elev, 0) ELSE elev END AS elev, CASE WHEN elev < 3 THEN row % 9 = 4 END AS managed FROM g),
  o AS (SELECT row, col, row * 40 + col AS id FROM c WHERE managed = false AND elev < 20),
  p(row, col, top) USING KEY (row, col) AS (SELECT row, col, id FROM o UNION (SELECT o.row, o.col, min(p.top) FROM p JOIN o ON abs(o.row - p.row) + abs(o.col - p.col) = 1 JOIN recurring.p AS r ON r.row = o.row AND r.col = o.col WHERE p.top < r.top GROUP BY 1, 2)),
  sea AS (SELECT row, col FROM p WHERE top IN (SELECT top FROM p GROUP BY 1 HAVING count(*) >= 3 AND bool_or(col = 0))),
  bank AS (SELECT w.row, w.col, arg_min(l.elev, (pow(w.row - l.row, 2) + pow(w.col - l.col, 2), l.elev)) AS bank FROM c w, c l WHERE w.managed AND l.managed IS NULL AND l.elev < 19 GROUP BY 1, 2),
  near AS (SELECT DISTINCT row + a AS row, col + b AS col FROM o, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE abs(a) + abs(b) <= 2),
  band AS (SELECT * FROM near ANTI JOIN o USING (row, col)),
  h AS (SELECT row, col, greatest(CASE WHEN bank IS NOT NULL AND elev < 19 THEN greatest(bank, 0.1) ELSE elev END, CASE WHEN band.row IS NOT NULL AND elev < 19 THEN 1.0 ELSE -1e9 END)::DOUBLE AS elev FROM c LEFT JOIN bank USING (row, col) LEFT JOIN band USING (row, col)),
  t(row, col, level) USING KEY (row, col) AS (SELECT row, col, elev FROM h SEMI JOIN sea USING (row, col)
    UNION (SELECT h.row, h.col, min(greatest(t.level, h.elev)) FROM t JOIN h ON abs(h.row - t.row) + abs(h.col - t.col) = 1 LEFT JOIN recurring.t AS r ON r.row = h.row AND r.col = h.col WHERE r.row IS NULL OR greatest(t.level, h.elev) < r.level GROUP BY 1, 2)),
  f AS (SELECT c.row, c.col, CASE WHEN managed IS NULL THEN greatest(elev, 0.1) ELSE elev END AS elev, CASE WHEN level IS NOT NULL THEN CASE WHEN managed IS NULL THEN greatest(level, 0.1) ELSE level END END AS level FROM c LEFT JOIN t ON t.row = c.row AND t.col = c.col)"""


@query("flood_grid", f"WITH RECURSIVE {_FLOODED} SELECT row, col, elev, level FROM f")
def flood_grid(spark, sf):
    """The whole composition: water, canals, walls, sea, banks, levels."""
    return _flooded(spark, sf)


@query("flood_exposure", f"""WITH RECURSIVE {PTS}, {_FLOODED}, x AS (SELECT id, least(greatest(floor(abs(lon) % 40), 0), 39)::INT AS col, least(greatest(floor(40 - abs(lat) % 40), 0), 39)::INT AS row FROM pts)
  SELECT id, round(greatest(level, CASE WHEN level IS NOT NULL THEN 0.1 END), 2) AS level, round(greatest(elev, 0), 1) AS ground FROM x LEFT JOIN f USING (row, col)""")
def flood_exposure(spark, sf):
    """Customers as buildings over the flood grid."""
    features = points(spark, sf).selectExpr("id", "abs(lon) % 40 AS lon", "abs(lat) % 40 AS lat")
    return flood.exposure(features, _flooded(spark, sf), 0.0, 40.0, 1.0, 40, 40).select("id", "level", "ground")


@query("burnt_barriers", """WITH g AS (SELECT ((p_partkey - 1) // 40)::INT AS row, ((p_partkey - 1) % 40)::INT AS col, ((p_partkey * p_partkey * 31 + p_partkey * 17) % 97)::DOUBLE / 10 AS elev FROM part),
  s AS (SELECT s_suppkey % 25 * 1.5::DOUBLE + 3.0::DOUBLE * k / 17 AS x, s_suppkey % 25 * 1.0::DOUBLE + 3.0::DOUBLE * k / 17 AS y FROM supplier, (SELECT unnest(range(18)) AS k)),
  b AS (SELECT DISTINCT row, col FROM g JOIN s ON sqrt(pow(col + 0.5 - x, 2) + pow(row + 0.5 - y, 2)) <= 2)
  SELECT row, col, CASE WHEN b.row IS NOT NULL THEN greatest(elev, 20.0) ELSE elev END AS elev FROM g LEFT JOIN b USING (row, col)""")
def burnt_barriers(spark, sf):
    """Cells of line barriers on the grid, raised."""
    seg = table(spark, sf, "supplier").selectExpr("s_suppkey % 25 * 1.5D AS x1", "40 - s_suppkey % 25 * 1.0D AS y1", "s_suppkey % 25 * 1.5D + 3 AS x2", "37 - s_suppkey % 25 * 1.0D AS y2")
    return flood.with_barriers(_grid(spark, sf), flood.line_cells(seg, 0.0, 40.0, 1.0), flood.WALL)


@query("polygon_raster", """WITH z AS (SELECT (s_suppkey * 37 % 600)::DOUBLE / 10 AS x, (s_suppkey * 53 % 450)::DOUBLE / 10 AS y FROM supplier), p AS (SELECT r, c, (c + 0.5)::DOUBLE * (0.5::DOUBLE / 3) AS lon, 70 - (r + 0.5)::DOUBLE * (0.5::DOUBLE / 3) AS lat FROM (SELECT unnest(range(421)) AS r), (SELECT unnest(range(800)) AS c)),
  i AS (SELECT DISTINCT r, c FROM p JOIN z ON lon > x AND lat > y AND (lon - x) / 12 + (lat - y) / 15 < 1) SELECT (r // 3)::INT AS row, (c // 3)::INT AS col FROM i GROUP BY 1, 2 HAVING count(*) / 9.0 >= 0.45""")
def polygon_raster(spark, sf):
    """Triangles rasterised on a half-degree grid: cells covered for 45 percent or more."""
    z = table(spark, sf, "supplier").selectExpr("cast(s_suppkey * 37 % 600 AS double) / 10 AS x", "cast(s_suppkey * 53 % 450 AS double) / 10 AS y")
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    return flood.polygon_cells(z.select(F.array(corner(0.0, 0.0), corner(12.0, 0.0), corner(0.0, 15.0)).alias("ring")), 0.0, 70.0, 0.5)


@query("polygon_raster_with_holes", """WITH z AS (SELECT (s_suppkey * 37 % 600)::DOUBLE / 10 AS x, (s_suppkey * 53 % 450)::DOUBLE / 10 AS y FROM supplier), p AS (SELECT r, c, (c + 0.5)::DOUBLE * (0.5::DOUBLE / 3) AS lon, 70 - (r + 0.5)::DOUBLE * (0.5::DOUBLE / 3) AS lat FROM (SELECT unnest(range(421)) AS r), (SELECT unnest(range(800)) AS c)),
  i AS (SELECT DISTINCT r, c FROM p JOIN z ON lon > x AND lat > y AND (lon - x) / 12 + (lat - y) / 15 < 1 AND NOT (lon > x + 2.02 AND lat > y + 2.03 AND (lon - x - 2.02) / 4 + (lat - y - 2.03) / 5 < 1)) SELECT (r // 3)::INT AS row, (c // 3)::INT AS col FROM i GROUP BY 1, 2 HAVING count(*) / 9.0 >= 0.45""")
def polygon_raster_with_holes(spark, sf):
    """The triangles of `polygon_raster`, each with a smaller one cut out."""
    z = table(spark, sf, "supplier").selectExpr("cast(s_suppkey * 37 % 600 AS double) / 10 AS x", "cast(s_suppkey * 53 % 450 AS double) / 10 AS y")
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    ring, hole = F.array(corner(0.0, 0.0), corner(12.0, 0.0), corner(0.0, 15.0)), F.array(corner(2.02, 2.03), corner(6.02, 2.03), corner(2.02, 7.03))
    return flood.polygon_cells(z.select(ring.alias("ring"), F.array(hole).alias("holes")), 0.0, 70.0, 0.5)


@query("alternative_ways", None)
def alternative_ways(spark, sf):
    """The best way between two parts and others that avoid its lines (tests compare with a heap)."""
    p = table(spark, sf, "part").selectExpr("p_partkey AS k")
    up = p.where("k > 1").selectExpr("k AS src", "k div 2 AS dst", "cast(1 + k % 5 AS double) AS cost", "concat('L', k % 3) AS line").unionByName(p.where("k >= 7").selectExpr("k AS src", "k div 7 AS dst", "cast(2 + k % 3 AS double) AS cost", "concat('M', k % 4) AS line"))
    edges = up.unionByName(up.selectExpr("dst AS src", "src AS dst", "cost", "line"))
    start = table(spark, sf, "part").where("p_partkey = 150").selectExpr("p_partkey AS node", "0D AS cost", "p_partkey AS label")
    ways = graph.alternatives(edges, start, table(spark, sf, "part").where("p_partkey = 2").selectExpr("p_partkey AS node"))
    return ways.select("rank", "cost", F.array_join("lines", ",").alias("lines"), F.array_join("nodes", ",").alias("nodes"))


@query("vertex_graph", f"""WITH {PTS}, v AS (SELECT nation AS line, id, round(lon, 5) AS x, round(lat, 5) AS y, lead(round(lon, 5)) OVER w AS x2, lead(round(lat, 5)) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY nation ORDER BY id)) SELECT line, 2 * count(*)::BIGINT AS edges, round(2 * sum(sqrt(pow(x - x2, 2) + pow(y - y2, 2))), 4) AS length FROM v WHERE x2 IS NOT NULL AND (x <> x2 OR y <> y2) GROUP BY 1""")
def vertex_graph(spark, sf):
    """The track graph of each nation's points as a line: edges both ways and their length."""
    p = points(spark, sf).groupBy(F.col("nation").alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "lon", "lat"))), lambda v: F.struct(v["lon"].alias("x"), v["lat"].alias("y"))).alias("points"))
    return graph.line_graph(p).groupBy("line").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("cost"), 4).alias("length"))


@query("boxes_of_bounds", f"WITH {PTS} SELECT id, round(2 * ((lon + 1) - lon) + ((lat + 2) - lat), 6) AS length, 4 AS corners FROM pts")
def boxes_of_bounds(spark, sf):
    """Bounding boxes as rings of four corners: the length of three sides."""
    ring = geo.box_ring(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 2)
    side = lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"])
    hops = F.zip_with(F.slice("ring", 1, 3), F.slice("ring", 2, 3), side)
    return points(spark, sf).select("id", ring.alias("ring")).select("id", F.round(F.aggregate(hops, F.lit(0.0), lambda a, x: a + x), 6).alias("length"), F.size("ring").alias("corners"))
