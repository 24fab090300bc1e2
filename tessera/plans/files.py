"""Queries over files and tables that are first written from the given tables into the shared folder, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cells
from ..operators import graph, versioned
from ..sources import io
from .fixtures import PTS, parent_sql, points
from .registry import query, table


def folder(spark, name):
    return f"{graph.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("box_scan", f"WITH {PTS} SELECT id, 'n' || nation AS name FROM pts WHERE lon <= 60 AND lon + 2 >= -10 AND lat <= 40 AND lat + 1 >= -40")
def box_scan(spark, sf):
    """Rows whose box overlaps a box: filter and nested fields reach the scan."""
    path = folder(spark, "boxes")
    box = F.struct(F.col("lon").alias("xmin"), (F.col("lon") + 2).alias("xmax"), F.col("lat").alias("ymin"), (F.col("lat") + 1).alias("ymax"))
    points(spark, sf).select("id", box.alias("bbox"), F.struct(F.concat(F.lit("n"), F.col("nation")).alias("primary"), F.lit("x").alias("other")).alias("names")).write.parquet(path)
    return io.box_scan(spark, path, (-10.0, -40.0, 60.0, 40.0), ["id", F.col("names.primary").alias("name")])


@query("catalog_scan", f"WITH {PTS}, z AS (SELECT *, floor(lon / 20)::BIGINT AS zone FROM pts), c AS (SELECT zone FROM z GROUP BY 1 HAVING min(lon) <= 33 AND max(lon) >= -7 AND min(lat) <= 50 AND max(lat) >= 10) SELECT id, cents FROM z WHERE zone IN (SELECT zone FROM c)")
def catalog_scan(spark, sf):
    """One folder for each zone of longitude; only those whose box overlaps are read."""
    path = folder(spark, "zones")
    rows = points(spark, sf).withColumn("zone", F.floor(F.col("lon") / 20))
    rows.repartition("zone").write.partitionBy("zone").parquet(path)
    ends = [f("l" + c).alias(n) for f, c, n in ((F.min, "on", "w"), (F.min, "at", "s"), (F.max, "on", "e"), (F.max, "at", "n"))]
    catalog = rows.groupBy("zone").agg(*ends).withColumn("path", F.concat(F.lit(f"{path}/zone="), F.col("zone").cast("string")))
    return io.catalog_scan(spark, catalog, (-7.0, 10.0, 33.0, 50.0), "id long, cents long")


@query("coarse_cells", f"WITH {PTS}, k AS (SELECT min({parent_sql('cell', 5)}) AS top FROM pts) SELECT id, cell FROM pts, k WHERE {parent_sql('cell', 5)} = top")
def coarse_cells(spark, sf):
    """A table in partitions by coarse cell, and one of them read."""
    path, pts = folder(spark, "coarse"), points(spark, sf).select("id", "cell")
    io.write_by_coarse_cell(pts, path, "cell", 5)
    top = pts.agg(F.min(cells.parent(F.col("cell"), 5))).first()[0]
    return spark.read.parquet(path).where(F.col("cell0") == F.lit(top)).select("id", "cell")


@query("units_csv", "SELECT event_id::VARCHAR AS name, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 700)::DOUBLE / 10 END AS wind FROM events")
def units_csv(spark, sf):
    """A CSV with a units row below its header, and numbers that aren't."""
    path = folder(spark, "units")
    rows = table(spark, sf, "events").selectExpr("cast(event_id AS string) AS NAME", "CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE cast(cast(event_id % 700 AS double) / 10 AS string) END AS WIND", "'z' AS OTHER")
    rows.unionByName(spark.range(1).selectExpr("'' AS NAME", "'kts' AS WIND", "'' AS OTHER")).write.csv(path, header=True)
    return io.units_csv(spark, path, ["NAME", "WIND"], ["WIND"], F.col("WIND") == "kts").select(F.col("NAME").alias("name"), F.col("WIND").alias("wind"))


@query("piped_table", "SELECT c_custkey::VARCHAR AS id, (c_custkey % 1000)::DOUBLE AS value FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 10 <> 0")
def piped_table(spark, sf):
    """A pipe-delimited table of all levels: one level's rows without the missing ones."""
    path = folder(spark, "piped")
    rows = table(spark, sf, "customer").selectExpr("concat(CASE c_custkey % 3 WHEN 1 THEN '1400000US' ELSE '0500000US' END, c_custkey) AS GEO_ID", "CASE WHEN c_custkey % 10 = 0 THEN '-666666666' ELSE cast(c_custkey % 1000 AS string) END AS B1")
    rows.write.csv(path, header=True, sep="|")
    return io.piped(spark, path, "GEO_ID", "140", "B1")


@query("tab_places", "WITH r AS (SELECT c_custkey AS id, (c_custkey % 83)::DOUBLE / 8 AS lat, (c_custkey % 59)::DOUBLE / 4 AS lon FROM customer WHERE c_custkey % 7 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY id) AS i FROM r) SELECT 'p' || id AS name, lat, lon FROM k WHERE i = 1")
def tab_places(spark, sf):
    """Tab-separated lines, some too short: the first place of each rounded coordinate."""
    path = folder(spark, "places")
    line = F.expr("CASE WHEN c_custkey % 7 = 0 THEN concat_ws('\\t', 'z', c_custkey) ELSE concat_ws('\\t', 'z', concat('p', c_custkey), cast(c_custkey % 83 AS double) / 8, cast(c_custkey % 59 AS double) / 4) END")
    table(spark, sf, "customer").orderBy("c_custkey").select(line.alias("value")).write.text(path)
    return io.tab_places(spark, path, 4, 2, 3, 1)


@query("geojson_rings", "SELECT s_suppkey AS id, 4 AS corners, (s_suppkey % 90)::DOUBLE AS x FROM supplier WHERE s_suppkey % 3 < 2 UNION ALL SELECT s_suppkey, 5, (s_suppkey % 90)::DOUBLE + 1 FROM supplier WHERE s_suppkey % 3 = 1")
def geojson_rings(spark, sf):
    """Feature collections (one for each nation) of polygons, multipolygons and points: their outer rings."""
    path = folder(spark, "features")
    ring = lambda x, n: "concat('[', array_join(array(" + ", ".join(f"concat('[', {x} + {i % (n - 1)}.0D, ',', {i % 2}.0, ']')" for i in range(n)) + "), ','), ']')"
    x = "cast(s_suppkey % 90 AS double)"
    coordinates = f"CASE s_suppkey % 3 WHEN 0 THEN concat('[', {ring(x, 4)}, ']') WHEN 1 THEN concat('[[', {ring(x, 4)}, ',', {ring(x, 3)}, '],[', {ring(x + ' + 1', 5)}, '],[', {ring(x, 3)}, ']]') ELSE '[0,0]' END"
    rows = table(spark, sf, "supplier").selectExpr("s_nationkey AS nation", f"""concat('{{"type":"Feature","properties":{{"id":"', s_suppkey, '"}},"geometry":{{"type":"', element_at(array('Polygon', 'MultiPolygon', 'Point'), cast(s_suppkey % 3 + 1 AS int)), '","coordinates":', {coordinates}, '}}}}') AS f""")
    whole = rows.groupBy("nation").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    whole.repartition("nation").write.partitionBy("nation").text(path)
    found = io.outer_rings(io.geojson_features(spark, path))
    return found.select(F.col("properties")["id"].cast("long").alias("id"), F.size("ring").alias("corners"), F.col("ring")[0]["x"].alias("x"))


@query("header_rows", "SELECT '8' || lpad(n_nationkey::VARCHAR, 3, '0') AS geoid, c_custkey::VARCHAR AS pop FROM nation JOIN customer ON c_nationkey = n_nationkey")
def header_rows(spark, sf):
    """JSON arrays whose first row is the header, columns in any order; an id of several columns."""
    own = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), F.to_json(F.array(F.col("c_custkey").cast("string"), F.lit("8"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))).alias("r"))
    docs = own.groupBy("n").agg(F.concat(F.lit('[["POP","state","county"],'), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("j"))
    return io.header_rows(docs, "j", ["state", "county", "POP"]).select(F.concat("state", "county").alias("geoid"), F.col("POP").alias("pop"))


@query("sorted_cells", f"WITH {PTS} SELECT id, cell, true AS numbers_are_smaller FROM pts")
def sorted_cells(spark, sf):
    """The table sorted by cell, as numbers and as text, read back from the text; which is smaller."""
    path = folder(spark, "sorted")
    sizes = io.write_encodings(points(spark, sf).select("id", "cell"), path, "cell")
    back = spark.read.parquet(f"{path}/text").select("id", cells.from_text(F.col("cell")).alias("cell"))
    return back.withColumn("numbers_are_smaller", F.lit(sizes["int"] < sizes["text"]))


@query("csv_export", f"WITH {PTS}, r AS (SELECT nation, id, cents, row_number() OVER (PARTITION BY nation ORDER BY cents DESC, id) AS rank FROM pts) SELECT nation, rank, id, 'a, \"' || cents || '\"' AS note FROM r WHERE rank <= 3")
def csv_export(spark, sf):
    """A ranked result as CSV with a header, quotes and commas, read back."""
    from ..operators import ranking

    path = folder(spark, "export")
    top = ranking.top_per_group(points(spark, sf).select("nation", "id", "cents"), ["nation"], [F.desc("cents"), "id"], 3)
    io.write_csv(top.select("nation", "rank", "id", F.concat(F.lit('a, "'), F.col("cents"), F.lit('"')).alias("note")), path)
    return spark.read.csv(path, header=True, schema="nation int, rank int, id long, note string")


def _versions(spark, sf):
    """A table made from the parts: created, filled twice, changed, reshaped; one snapshot each."""
    t = versioned.VersionedTable(spark, folder(spark, "table"))
    t.create("id string, pos long, name string, size int")
    rows = table(spark, sf, "part").selectExpr("cast(p_partkey AS string) AS id", "p_partkey AS pos", "p_name AS name", "p_size AS size", "p_partkey AS k")
    t.append(rows.where("k % 2 = 0").drop("k"))
    t.append(rows.where("k % 2 = 1").withColumn("extra", F.lit("e")).drop("k"))
    t.update(rows.where("k % 5 = 0").select("id", F.lit(-1).alias("size")))
    t.delete(rows.where("k % 7 = 0").select("id"))
    t.rename_column("name", "title")
    t.set_column("twice", F.col("size") * 2)
    t.drop_column("extra")
    return t


@query("versioned_latest", "SELECT p_partkey::VARCHAR AS id, p_partkey AS pos, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS size, 2 * CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS twice FROM part WHERE p_partkey % 7 <> 0")
def versioned_latest(spark, sf):
    return _versions(spark, sf).latest().select("id", "pos", "title", "size", "twice")


@query("versioned_history", "WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 2 = 0) AS even, count(*) FILTER (p_partkey % 7 <> 0) AS rest FROM part) SELECT unnest(range(8)) AS version, unnest([0, even, n, n, rest, rest, rest, rest]) AS n, unnest([4, 4, 5, 5, 5, 5, 6, 5]) AS columns FROM n")
def versioned_history(spark, sf):
    """Rows and columns of every snapshot, oldest first."""
    t = _versions(spark, sf)
    each = [(df := t.at(stamp)).agg(F.lit(i).cast("long").alias("version"), F.count(F.lit(1)).alias("n"), F.lit(len(df.columns)).alias("columns")) for i, stamp in enumerate(t.history())]
    return io.union_all(each)
