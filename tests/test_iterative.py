"""Iterative and stateful operators against plain loops."""

import heapq
import math
import random

from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import flood, graph, joins, ranking, versioned
from tessera.sources import io
from tessera.streaming import live


def test_shortest_paths_and_labels(spark):
    rnd = random.Random(3)
    edges = [(i, rnd.randrange(40), float(rnd.randrange(1, 9))) for i in range(40) for _ in range(3)]
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    got = {r["node"]: (r["cost"], r["label"]) for r in graph.shortest(df, spark.createDataFrame([(0, 0.0, 0), (7, 0.0, 7)], "node long, cost double, label long")).collect()}
    best, heap = {}, [(0.0, 0, 0), (0.0, 7, 7)]
    while heap:
        c, label, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = (c, label)
        for a, b, w in edges:
            if a == n and b not in best:
                heapq.heappush(heap, (c + w, label, b))
    assert got == best


def test_connected_parts(spark):
    rnd = random.Random(9)
    nodes = list(range(300))
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    top = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = graph.connected(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r["node"]: r["component"] for r in got.collect()} == top
    alone = graph.connected(spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(3,)], "node long"))
    assert [tuple(r) for r in alone.collect()] == [(3, 3)]


def test_flood_levels(spark):
    rnd = random.Random(5)
    elev = {(r, c): float(rnd.randrange(20)) for r in range(9) for c in range(11) if (r, c) != (4, 4)}
    grid = spark.createDataFrame([(r, c, e) for (r, c), e in elev.items()], "row int, col int, elev double")
    got = {(r["row"], r["col"]): r["level"] for r in flood.flood_levels(grid, grid.where("col = 0")).collect()}
    want, heap = {}, [(e, at) for at, e in elev.items() if at[1] == 0]
    heapq.heapify(heap)
    while heap:
        x, (r, c) = heapq.heappop(heap)
        if (r, c) in want:
            continue
        want[r, c] = x
        for dr, dc in flood.STEPS:
            at = (r + dr, c + dc)
            if at in elev and at not in want:
                heapq.heappush(heap, (max(x, elev[at]), at))
    assert got == want


def test_sea_water_banks_and_dilation(spark):
    water = [(0, 0), (0, 1), (1, 1), (3, 3), (3, 4), (5, 0)]
    df = spark.createDataFrame(water, "row int, col int")
    sea = {tuple(r) for r in flood.sea_water(df, df.where("col = 0"), 2).collect()}
    assert sea == {(0, 0), (0, 1), (1, 1)}
    assert {tuple(r) for r in flood.dilated(spark.createDataFrame([(2, 2)], "row int, col int"), 1).collect()} == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}
    grid = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(6) for c in range(6)], "row int, col int, elev double")
    banks = {(r["row"], r["col"]): r["bank"] for r in flood.nearest_land(grid, df, 4).collect()}
    land = {(r, c): 10 * r + c for r in range(6) for c in range(6) if (r, c) not in water}
    for r, c in water:
        d = min((r - a) ** 2 + (c - b) ** 2 for a, b in land)
        assert banks[r, c] == min(v for (a, b), v in land.items() if (r - a) ** 2 + (c - b) ** 2 == d)


def _km(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def test_radius_join_at_poles_and_antimeridian(spark):
    rnd = random.Random(11)
    pts = [(i, rnd.choice([rnd.uniform(-90, 90), rnd.uniform(84, 90), rnd.uniform(-90, -86)]), rnd.choice([rnd.uniform(-180, 180), rnd.uniform(178, 180), rnd.uniform(-180, -178)])) for i in range(220)]
    left = spark.createDataFrame(pts, "id long, lat double, lon double")
    right = left.select(F.col("id").alias("site"), F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))
    for km in (60.0, 700.0):
        got = {(r["id"], r["site"]) for r in joins.radius_pairs(left, right, km).collect()}
        assert got == {(a[0], b[0]) for a in pts for b in pts if _km(a[1:], b[1:]) <= km}
    got = [(r["id"], r["site"]) for r in joins.nearest_k(left.limit(20), right, 2, 50).collect()]
    assert len(got) == 40 == len(set(got))


def test_greedy_and_samples(spark):
    pts = [(i, float(i % 7), float(i * 3 % 50), float(i * 37 % 101)) for i in range(60)]
    got = [r["id"] for r in ranking.greedy_apart(spark.createDataFrame(pts, "id long, lat double, lon double, score double"), "score", 900, 4).orderBy("pick").collect()]
    rest, want = sorted(pts, key=lambda p: (-p[3], p[0])), []
    while rest and len(want) < 4:
        want.append(rest[0][0])
        rest = [p for p in rest if _km(p[1:3], rest[0][1:3]) > 900]
    assert got == want
    for n, k in ((10, 3), (7, 7), (100, 9)):
        rows = spark.range(n).withColumnRenamed("id", "i")
        assert sorted(r["i"] for r in ranking.even_sample(rows, "i", n, k).collect()) == sorted({int(j * n / k) for j in range(min(n, k))} if k < n else set(range(n)))


def test_versioned_table(spark, tmp_path):
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t")
    t.create("id string, name string, pos long")
    t.append(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, pos long"))
    t.update(spark.createDataFrame([("b", "z")], "id string, name string"))
    t.delete(spark.createDataFrame([("a",)], "id string"))
    t.set_column("size", F.lit(3))
    assert [tuple(r) for r in t.latest().select("id", "name", "size").collect()] == [("b", "z", 3)]
    assert len(t.history()) == 5 and t.at(t.history()[1]).count() == 2
    try:
        t.update(spark.createDataFrame([("q", "z")], "id string, name string"))
        raise AssertionError("an unknown id was updated")
    except KeyError:
        pass


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("NAME,WIND\n,kts\nx,12\ny,\n")
    rows = io.units_csv(spark, f"file://{tmp_path}/a.csv", ["NAME", "WIND"], ["WIND"], F.col("WIND") == "kts").collect()
    assert [tuple(r) for r in rows] == [("x", 12.0), ("y", None)]
    (tmp_path / "b.txt").write_text("GEO_ID|V\n140US36001|5\n140US36002|-666\n150US1|7\n")
    assert [tuple(r) for r in io.piped(spark, f"file://{tmp_path}/b.txt", "GEO_ID", "140", "V").collect()] == [("36001", 5.0)]
    (tmp_path / "c.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    ring = io.outer_rings(io.geojson_features(spark, f"file://{tmp_path}/c.json")).collect()[0]["ring"]
    assert [tuple(p) for p in ring] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([('[["NAME","POP"],["a","1"],["b","2"]]',)], "j string")
    assert [tuple(r) for r in io.header_rows(df, "j", ["POP", "NAME"]).collect()] == [("1", "a"), ("2", "b")]
    io.write_sorted(spark.range(100), f"file://{tmp_path}/s", "id", 3)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 100


def test_streams_drop_late_rows_and_repeat_nothing(spark, tmp_path):
    schema = "hex string, cs string, reg string, lat double, lon double, alt_baro string, gs double, squawk string, ts timestamp"
    one = spark.createDataFrame([("a", " ", "R1", 1.0, 1.0, "5000", 1.0, "7700", "2024-01-01 00:01:00"), ("a", " ", "R1", 1.0, 1.0, "9000", 1.0, "7700", "2024-01-01 00:02:00"), ("b", " ", "R1", 1.0, 1.0, "ground", 1.0, "1200", "2024-01-01 00:02:00"), ("c", " ", "R1", 1.0, 1.0, "35000", 1.0, "1200", "2024-01-01 02:00:00")], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    one.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for name, df in (("pulse", live.pulse_stream(stream)), ("codes", live.emergencies(stream))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r["band"], r["n"]) for r in spark.table("pulse").where("window.start < '2024-01-01 01:00:00'").collect()] == [("<10k", 1)]
    assert [(r["hex"], r["label"]) for r in spark.table("codes").collect()] == [("a", "R1")]


def test_ring_area_and_containment(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.0, 2.0))))
    rows = spark.createDataFrame([(1.0, 0.5), (1.0, 1.5), (3.0, 1.0), (0.2, 1.7)], "x double, y double")
    assert [r[0] for r in rows.select(geo.ring_contains(ring, F.col("x"), F.col("y"))).collect()] == [True, False, False, True]
