"""Queries over pixel tables: pyramids, windows, warps, chunk plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster
from .fixtures import PIXELS, pixels
from .registry import query, table


@query("pixel_centers", f"WITH {PIXELS} SELECT row, col, round(10 + (col + 0.5) * (4.0 / 128), 6) AS lon, round(50 - (row + 0.5) * (2.0 / 128), 6) AS lat FROM pixels")
def pixel_centers(spark, sf):
    lon, lat = raster.pixel_center(10.0, 50.0, 4.0, 2.0, 128, 128)
    return pixels(spark, sf).select("row", "col", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("pyramid", f"WITH {PIXELS}, l AS (SELECT unnest([2, 4, 8]) AS level) SELECT level, row // level AS row, col // level AS col, round(avg(value), 6) AS value, count(*) AS n FROM pixels, l GROUP BY 1, 2, 3")
def pyramid(spark, sf):
    return raster.pyramid(pixels(spark, sf), [2, 4, 8]).withColumn("value", F.round("value", 6))


_CAT = "c AS (SELECT p_partkey AS raster, 300 + p_partkey * 37 % 5000 AS width, 200 + p_partkey * 53 % 4000 AS height, 10.0 AS res FROM part)"
_LEVELS = f"""{_CAT}, k AS (SELECT *, unnest(range(greatest(floor(log2(greatest(width, height) / 512.0)), 1)::INT + 1)) AS k FROM c), l AS (SELECT raster, k::INT AS k, ceil(width / pow(2, k))::BIGINT AS width, ceil(height / pow(2, k))::BIGINT AS height, res * pow(2, k) AS res FROM k),
  m AS (SELECT *, (ceil(width / 256.0) * ceil(height / 256.0))::BIGINT AS blocks, width * height * 2 AS bytes FROM l)"""


def _levels(spark, sf):
    cat = table(spark, sf, "part").selectExpr("p_partkey AS raster", "300 + p_partkey * 37 % 5000 AS width", "200 + p_partkey * 53 % 4000 AS height", "10.0D AS res")
    return raster.level_table(cat, 2, 256)


@query("level_table", f"WITH {_LEVELS} SELECT raster, k, width, height, res, blocks, bytes, round(100.0 * bytes / sum(bytes) OVER (PARTITION BY raster), 6) AS percent FROM m")
def level_table(spark, sf):
    return _levels(spark, sf).withColumn("percent", F.round("percent", 6))


@query("level_for", f"WITH {_LEVELS} SELECT raster, coalesce(max(k) FILTER (res <= (5 + raster % 60) * 1.4), 0) AS k FROM m GROUP BY 1")
def level_for(spark, sf):
    return raster.level_for(_levels(spark, sf), F.col("raster") % 60 + 5.0)


@query("missing_pyramids", f"""WITH {_LEVELS}, a AS (SELECT raster, sum(width * height) FILTER (k > 0) AS added, max(width * height) FILTER (k = 0) AS whole FROM m GROUP BY 1)
  SELECT raster, added::BIGINT AS added, round(100 * added::DOUBLE / whole, 1) AS percent, trunc((added * (raster % 1000 * 997))::DOUBLE / whole * CASE raster % 3 WHEN 0 THEN 1.0 ELSE 1.5 END)::BIGINT AS estimate FROM a""")
def missing_pyramids(spark, sf):
    files = table(spark, sf, "part").selectExpr("p_partkey AS raster", "p_partkey % 1000 * 997 AS bytes", "element_at(array('JPEG', 'deflate', 'lzw'), cast(p_partkey % 3 + 1 AS int)) AS compression")
    return raster.missing_pyramids(_levels(spark, sf), files)


@query("fractional_windows", """WITH r AS (SELECT o_orderkey AS id, 100 + o_orderkey % 900 AS width, 50 + o_custkey % 700 AS height, (o_orderkey * 7 % 130 - 15) / 100.0::DOUBLE AS l, (o_orderkey * 11 % 90 - 10) / 100.0::DOUBLE AS t, (o_orderkey * 7 % 130 - 15) / 100.0::DOUBLE + (o_custkey % 50) / 100.0::DOUBLE AS r, 0.9::DOUBLE AS b FROM orders),
  c AS (SELECT id, width, height, floor(greatest(0, least(1, l)) * width)::BIGINT AS x0, floor(greatest(0, least(1, t)) * height)::BIGINT AS y0, least(width, round_even(greatest(0, least(1, r)) * width, 0))::BIGINT AS x1, least(height, round_even(greatest(0, least(1, b)) * height, 0))::BIGINT AS y1 FROM r),
  k AS (SELECT *, x1 - x0 >= 2 AND y1 - y0 >= 2 AND NOT (x0 = 0 AND y0 = 0 AND x1 = width AND y1 = height) AS ok FROM c)
  SELECT id, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN 500.0 + 10 * x0 END AS "left", CASE WHEN ok THEN 9000.0 - 10 * y1 END AS bottom FROM k""")
def fractional_windows(spark, sf):
    r = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "100 + o_orderkey % 900 AS width", "50 + o_custkey % 700 AS height", "cast(o_orderkey * 7 % 130 - 15 AS double) / 100 AS l", "cast(o_orderkey * 11 % 90 - 10 AS double) / 100 AS t", "cast(o_orderkey * 7 % 130 - 15 AS double) / 100 + cast(o_custkey % 50 AS double) / 100 AS r", "0.9D AS b")
    return raster.window_bounds(raster.fractional_window(r, ["l", "t", "r", "b"]), (10.0, 0.0, 500.0, 0.0, -10.0, 9000.0)).select("id", "x0", "y0", "x1", "y1", "left", "bottom")


@query("window_read", f"WITH {PIXELS} SELECT row, col, value FROM pixels WHERE row BETWEEN 10 AND 29 AND col BETWEEN 30 AND 99")
def window_read(spark, sf):
    return raster.window(pixels(spark, sf), (10, 30), (30, 100))


@query("same_ground", f"WITH {PIXELS}, l AS (SELECT unnest([2, 4]) AS level) SELECT level, row // level AS row, col // level AS col, round(avg(value), 6) AS value FROM pixels, l WHERE row BETWEEN 16 AND 31 AND col BETWEEN 16 AND 47 GROUP BY 1, 2, 3")
def same_ground(spark, sf):
    return raster.pyramid(raster.window(pixels(spark, sf), (16, 32), (16, 48)), [2, 4]).drop("n").withColumn("value", F.round("value", 6))


@query("mosaic", f"WITH {PIXELS} SELECT row // 32 * 256 + row % 32 AS row, col // 32 * 256 + col % 32 AS col, value FROM pixels WHERE row // 32 * 256 + row % 32 < 700")
def mosaic(spark, sf):
    tiles = pixels(spark, sf).selectExpr("row div 32 AS tile_y", "col div 32 AS tile_x", "row % 32 AS row", "col % 32 AS col", "value")
    return raster.mosaic(tiles).where("row < 700")


@query("decimated", f"WITH {PIXELS} SELECT row, col, value FROM pixels WHERE row % 5 = 0 AND col % 5 = 0")
def decimated(spark, sf):
    return raster.decimated(pixels(spark, sf), 5)


@query("warped", f"WITH {PIXELS} SELECT t.row AS trow, t.col AS tcol, s.value FROM (SELECT row, col FROM pixels) t LEFT JOIN pixels s ON s.row = floor(t.row * 0.75 + t.col * 0.125) AND s.col = floor(t.col * 0.5 + 3)")
def warped(spark, sf):
    px = pixels(spark, sf)
    target = px.select(F.col("row").alias("trow"), F.col("col").alias("tcol"))
    return raster.warp(px, target, F.col("trow") * 0.75 + F.col("tcol") * 0.125, F.col("tcol") * 0.5 + 3)


@query("stretched", f"""WITH {PIXELS}, p AS (SELECT row % 3 AS band, row, col, value FROM pixels), e AS (SELECT band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM p GROUP BY 1)
  SELECT band, row, col, greatest(0, least(255, floor((value - lo) / (hi - lo) * 255 + 0.0)))::INT AS value FROM p JOIN e USING (band)""")
def stretched(spark, sf):
    return raster.stretched(pixels(spark, sf).withColumn("band", F.col("row") % 3)).select("band", "row", "col", "value")


@query("composite", f"""WITH {PIXELS}, p AS (SELECT row % 4 AS band, row // 4 AS y, col, value FROM pixels WHERE row % 4 > 0), e AS (SELECT band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM p GROUP BY 1),
  s AS (SELECT band, y, col, greatest(0, least(255, floor((value - lo) / (hi - lo) * 255 + 0.0)))::INT AS v FROM p JOIN e USING (band)) SELECT y AS row, col, max(v) FILTER (band = 1) AS r, max(v) FILTER (band = 2) AS g, max(v) FILTER (band = 3) AS b FROM s GROUP BY 1, 2""")
def composite(spark, sf):
    return raster.composite(pixels(spark, sf).where("row % 4 > 0").selectExpr("row % 4 AS band", "row div 4 AS row", "col", "value"))


@query("chunk_plan", "WITH w AS (SELECT o_orderkey AS id, o_orderkey % 300 AS a, o_custkey % 500 AS b FROM orders), x AS (SELECT id, unnest(range(a // 90, (a + 119) // 90 + 1)) AS i, b FROM w), y AS (SELECT id, i, unnest(range(b // 180, (b + 99) // 180 + 1)) AS j FROM x) SELECT id, 'c/' || i || '/' || j AS key FROM y")
def chunk_plan(spark, sf):
    w = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "array(o_orderkey % 300, o_custkey % 500) AS lo", "array(o_orderkey % 300 + 120, o_custkey % 500 + 100) AS hi")
    return raster.chunk_plan(w, [90, 180]).select("id", "key")


@query("point_chunks", "SELECT o_orderkey AS id, 'c/' || (o_orderkey % 300) // 90 || '/' || (o_custkey % 500) // 180 AS key, (o_orderkey % 300) % 90 * 180 + (o_custkey % 500) % 180 AS \"offset\" FROM orders")
def point_chunks(spark, sf):
    p = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 300 AS y", "o_custkey % 500 AS x")
    return raster.point_chunk(p, ["y", "x"], [90, 180]).select("id", "key", "offset")


@query("array_inventory", """WITH a AS (SELECT p_partkey % 20 AS store, CASE p_partkey % 5 WHEN 0 THEN 'cloud_mask' WHEN 1 THEN 'lat' ELSE 'v' END || p_partkey || CASE p_partkey % 5 WHEN 1 THEN '_bnds' ELSE '' END AS name, (p_size + 1)::BIGINT AS y, p_partkey % 50 + 1 AS x, p_partkey % 2 = 0 AS float FROM part),
  k AS (SELECT *, ceil(y / 7.0)::BIGINT AS gy, ceil(x / 16.0)::BIGINT AS gx, row_number() OVER (PARTITION BY store ORDER BY name LIKE '%bnds%', name LIKE '%mask%', y * x DESC, float DESC, name) = 1 AS best FROM a)
  SELECT name, gy AS grid_y, gx AS grid_x, gy * gx AS n_chunks, y * x * 4 AS bytes, best AND name NOT LIKE '%bnds%' AS preferred FROM k""")
def array_inventory(spark, sf):
    a = table(spark, sf, "part").selectExpr("p_partkey % 20 AS store", "concat(CASE p_partkey % 5 WHEN 0 THEN 'cloud_mask' WHEN 1 THEN 'lat' ELSE 'v' END, p_partkey, CASE p_partkey % 5 WHEN 1 THEN '_bnds' ELSE '' END) AS name", "array(cast(p_size + 1 AS bigint), p_partkey % 50 + 1) AS shape", "array(7L, 16L) AS chunks", "4 AS itemsize", "CASE WHEN p_partkey % 2 = 0 THEN 'float32' ELSE 'int16' END AS dtype")
    return raster.inventory(a).select("name", F.col("grid")[0].alias("grid_y"), F.col("grid")[1].alias("grid_x"), "n_chunks", "bytes", "preferred")


@query("read_ledger", "SELECT user_id % 40 AS key, count(*) AS requests, sum(CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 ELSE 0 END)::BIGINT AS fetched, sum((event_id % 3 = 0)::INT)::BIGINT AS hits FROM events GROUP BY 1")
def read_ledger(spark, sf):
    return raster.read_ledger(table(spark, sf, "events").selectExpr("user_id % 40 AS key", "event_id % 1000 AS bytes", "event_id % 3 = 0 AS hit"))


@query("loss_pixels", f"WITH {PIXELS} SELECT row, col, value % 256 AS intensity, 2000 + value // 256 AS year FROM pixels WHERE 2000 + value // 256 BETWEEN 2005 AND 2010")
def loss_pixels(spark, sf):
    return pixels(spark, sf).selectExpr("row", "col", "value % 256 AS intensity", "cast(2000 + value div 256 AS int) AS year").where("year BETWEEN 2005 AND 2010")
