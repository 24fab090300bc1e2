"""Flood grids, alternative ways, arrays, folds and settings against plain Python."""

import heapq
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.operators import flood, graph
from tessera.sources import arrays
from tessera.streaming import fold, live

STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))


def plain_flood(elev, water, walls, edge, bank_least, least_cells):
    n, m = elev.shape
    elev = elev.copy()
    for at in water:
        elev[at] = min(elev[at], 0.0)
    for at in walls:
        elev[at] = 20.0
    open_ = {at for at, managed in water.items() if not managed and elev[at] < 20}
    seeds, seen = set(), set()
    for start in sorted(open_):
        if start in seen:
            continue
        part, todo = {start}, [start]
        while todo:
            r, c = todo.pop()
            for dr, dc in STEPS:
                at = (r + dr, c + dc)
                if at in open_ and at not in part:
                    part.add(at)
                    todo.append(at)
        seen |= part
        if len(part) >= least_cells and part & edge:
            seeds |= part
    fill = elev.copy()
    land = [(r, c) for r in range(n) for c in range(m) if (r, c) not in water and elev[r, c] < 19]
    for (r, c), managed in water.items():
        if managed and elev[r, c] < 19 and land:
            fill[r, c] = max(min(((a - r) ** 2 + (b - c) ** 2, elev[a, b]) for a, b in land)[1], 0.1)
    band = set(open_)
    for _ in range(2):
        band |= {(r + dr, c + dc) for r, c in band for dr, dc in STEPS}
    for at in band - open_:
        if 0 <= at[0] < n and 0 <= at[1] < m and elev[at] < 19:
            fill[at] = max(fill[at], bank_least)
    level = {at: fill[at] for at in seeds}
    heap = [(x, at) for at, x in level.items()]
    heapq.heapify(heap)
    while heap:
        x, (r, c) = heapq.heappop(heap)
        for dr, dc in STEPS:
            at = (r + dr, c + dc)
            if 0 <= at[0] < n and 0 <= at[1] < m and max(x, fill[at]) < level.get(at, np.inf):
                level[at] = max(x, fill[at])
                heapq.heappush(heap, (level[at], at))
    dry = lambda at, x: x if at in water else max(x, 0.1)
    return {(r, c): (dry((r, c), elev[r, c]), None if (r, c) not in level else dry((r, c), level[r, c])) for r in range(n) for c in range(m)}


def test_flood_grid_and_exposure(spark):
    rnd = random.Random(7)
    elev = np.array([[rnd.randrange(-20, 60) / 10 for _ in range(24)] for _ in range(20)])
    water = {(r, c): rnd.random() < 0.3 for r in range(20) for c in range(24) if c < 5 or rnd.random() < 0.2}
    walls, edge = [(r, 9) for r in range(0, 20, 2)], {(r, 0) for r in range(20)}
    cells = lambda rows, names: spark.createDataFrame(rows, names)
    grid = cells([(r, c, float(elev[r, c])) for r in range(20) for c in range(24)], "row int, col int, elev double")
    own = flood.flood_grid(grid, cells([(r, c, m) for (r, c), m in water.items()], "row int, col int, managed boolean"), cells(walls, "row int, col int"), cells(sorted(edge), "row int, col int"), 2.5, 4)
    own = graph.cut(own)
    found = {(r["row"], r["col"]): (r["elev"], r["level"]) for r in own.collect()}
    want = plain_flood(elev, water, walls, edge, 2.5, 4)
    assert found == want and len({x[1] for x in want.values()}) > 10
    features = cells([(1, 3.2, 15.5), (2, 99.0, -5.0)], "id int, lon double, lat double")
    rows = {r["id"]: r for r in flood.exposure(features, own, 0.0, 20.0, 1.0, 20, 24).collect()}
    for i, at in ((1, (4, 3)), (2, (19, 23))):
        e, x = want[at]
        assert rows[i]["level"] == (None if x is None else round(max(x, 0.1), 2)) and rows[i]["ground"] == round(max(e, 0.0), 1)


def plain_alternatives(edges, start, end):
    def best(slow):
        heap, done = [(0.0, start, ())], {}
        while heap:
            d, at, way = heapq.heappop(heap)
            if at in done:
                continue
            done[at] = way
            for a, b, w, line in edges:
                if a == at and b not in done:
                    heapq.heappush(heap, (d + w * (8 if line == slow and slow else 1), b, (*way, (a, b, w, line))))
        return done[end]

    first = best(None)
    ridden = {}
    for _, _, w, line in first:
        if line:
            ridden[line] = ridden.get(line, 0) + w
    ways = [first] + [best(x) for x in sorted(ridden, key=lambda k: (-ridden[k], k))[:3]]
    out = {}
    for way in ways:
        lines = [x[3] for x in way if x[3]]
        lines = tuple(x for i, x in enumerate(lines) if not i or lines[i - 1] != x)
        cost = sum(x[2] for x in way)
        out[lines] = min(out.get(lines, np.inf), cost)
    top = min(out.values())
    return sorted((c, x) for x, c in out.items() if c <= 1.6 * top)[:3]


def test_alternative_ways(spark):
    one = [(1, 2, 3.0, "a"), (2, 3, 3.01, "a"), (1, 4, 4.02, "b"), (4, 3, 4.03, "b"), (3, 5, 1.04, None), (5, 6, 5.05, "c"), (3, 7, 3.06, "d"), (7, 6, 6.07, "d"), (2, 4, 0.58, None), (1, 6, 40.0, "e")]
    edges = one + [(b, a, w, x) for a, b, w, x in one]
    df = spark.createDataFrame(edges, "src long, dst long, cost double, line string")
    rows = graph.alternatives(df, spark.createDataFrame([(1, 0.0, 1)], "node long, cost double, label long"), spark.createDataFrame([(6,)], "node long")).orderBy("rank").collect()
    want = plain_alternatives(edges, 1, 6)
    assert [(round(r["cost"], 6), tuple(r["lines"])) for r in rows] == [(round(c, 6), x) for c, x in want] and len(want) == 3
    assert all(r["nodes"][0] == 1 and r["nodes"][-1] == 6 for r in rows)


@pytest.mark.parametrize("codec,separator", [("zstd", "/"), ("gzip", "."), (None, "/")])
def test_array_windows(spark, tmp_path, codec, separator):
    whole = np.arange(10 * 7 * 9, dtype=np.float32).reshape(10, 7, 9) / 4
    chunks, folder = (4, 3, 5), tmp_path / "a"
    missing = {(1, 1, 0)}
    meta = {"shape": whole.shape, "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": separator}}, "fill_value": -1.0, "dimension_names": ["t", "y", "x"], "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec}] if codec else [])}
    padded = np.full((12, 9, 10), -1, np.float32)
    padded[:10, :7, :9] = whole
    for i in range(3):
        for j in range(3):
            for k in range(2):
                part = padded[i * 4 : i * 4 + 4, j * 3 : j * 3 + 3, k * 5 : k * 5 + 5].tobytes()
                part = pa.compress(part, codec="zstd", asbytes=True) if codec == "zstd" else part
                if codec == "gzip":
                    z = zlib.compressobj(wbits=31)
                    part = z.compress(part) + z.flush()
                path = folder / separator.join(["c", str(i), str(j), str(k)])
                path.parent.mkdir(parents=True, exist_ok=True)
                if (i, j, k) not in missing:
                    path.write_bytes(part)
    (folder / "zarr.json").write_text(json.dumps(meta))
    rows = arrays.read_window(spark, str(folder), (2, 1, 3), (9, 5, 99)).collect()
    want = {}
    for t in range(2, 9):
        for y in range(1, 5):
            for x in range(3, 9):
                want[t, y, x] = -1.0 if (t // 4, y // 3, x // 5) in missing else float(whole[t, y, x])
    assert {(r["t"], r["y"], r["x"]): r["value"] for r in rows} == want
    assert arrays.read_window(spark, str(folder), (5, 5, 5), (5, 6, 6)).count() == 0


def test_fold_takes_new_items_once_and_failed_ones_again(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    fails = {"b"}
    stream = lambda: spark.readStream.schema("name string, n long").json(str(inbox))
    convert = lambda df: df.withColumn("twice", F.col("n") * 2).withColumn("ok", ~F.col("name").isin(*fails, "never"))

    def poll(name, *rows):
        (inbox / f"{name}.json").write_text("\n".join(json.dumps({"name": a, "n": n}) for a, n in rows))
        fold.fold_items(stream(), "name", convert, folder).awaitTermination()
        return sorted((r["name"], r["twice"]) for r in spark.read.parquet(f"{folder}/done").collect())

    assert poll("1", ("a", 1), ("b", 2), ("a", 1)) == [("a", 2)]
    fails.clear()
    assert poll("2", ("a", 5), ("c", 3), ("never", 0)) == [("a", 2), ("b", 4), ("c", 6)]
    assert poll("3", ("d", 4)) == [("a", 2), ("b", 4), ("c", 6), ("d", 8)]


def test_fold_reads_only_what_is_new_and_survives_a_broken_poll(spark, tmp_path):
    inbox, folder = tmp_path / "in", str(tmp_path / "state")
    inbox.mkdir()
    broken = []

    def convert(df):
        if broken:
            raise RuntimeError("no network")
        return df.withColumn("ok", F.col("name") != "never")

    def poll(i, *names):
        (inbox / f"{i}.json").write_text("\n".join(json.dumps({"name": n}) for n in names))
        q = fold.fold_items(spark.readStream.schema("name string").json(str(inbox)), "name", convert, folder, max_tries=3)
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    first = poll(0, *(f"n{i}" for i in range(50)), "never")
    read = [poll(i, f"m{i}", "n3") for i in range(1, 6)]
    assert first == 51 and read == [3, 3, 2, 2, 2]  # two that arrive, and the failed one until its third try
    broken.append(True)
    with pytest.raises(Exception, match="no network"):
        poll(6, "late")
    broken.clear()
    poll(7, "last")
    done = [r["name"] for r in spark.read.parquet(f"{folder}/done").collect()]
    assert sorted(done) == sorted({*(f"n{i}" for i in range(50)), *(f"m{i}" for i in range(1, 6)), "late", "last"})


def test_nested_settings(spark):
    def flatten(obj, prefix=""):
        return {k: v for key, value in obj.items() for k, v in (flatten(value, f"{prefix}{key}.") if isinstance(value, dict) else {f"{prefix}{key}": value}).items()}

    rows = [{"a": {"b": {"c": 1, "d": "x"}, "e": None}, "f": [1, {"g": 2}], "h": {}, "i.j": True}, {}, {"z": "{not an object}"}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, None), (10, "no json")], "id int, s string")
    found = {(r["id"], r["path"]): json.loads(r["value"]) for r in records.leaf_paths(df, ["id"], "s").collect()}
    assert found == {(i, p): v for i, r in enumerate(rows) for p, v in flatten(r).items()}
    edit = lambda c: [json.loads(r[0]) for r in df.where("id < 3").orderBy("id").select(c).collect()]
    assert edit(records.json_set(F.col("s"), "a.b.c", F.lit("[5]")))[0]["a"] == {"b": {"c": [5], "d": "x"}, "e": None}
    assert edit(records.json_set(F.col("s"), "f.k", F.lit("7")))[0]["f"] == {"k": 7}
    assert edit(records.json_delete(F.col("s"), "a.b.d"))[0]["a"]["b"] == {"c": 1}
    assert edit(records.json_delete(F.col("s"), "f.k")) == rows


def test_search_circles_cover(spark):
    at = [(r["lat"], r["lon"]) for r in live.cover_circles(spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lon double"), 900.0).collect()]
    rnd = random.Random(1)
    for _ in range(300):
        r, a = 900 / 60 * rnd.random() ** 0.5, rnd.random() * 2 * np.pi
        y, x = r * np.sin(a), r * np.cos(a)
        assert min(np.hypot(y - p, x - q) for p, q in at) <= 250 / 60 + 1e-9


def test_densified_lines_bend(spark):
    line = spark.createDataFrame([(1, [(0.0, 0.0), (0.003, 0.0), (0.003, 0.004)]), (2, [(5.0, 5.0), (5.0, 5.0)])], "id int, points array<struct<x: double, y: double>>")
    rows = sorted((r["id"], r["k"], r["x"], r["y"]) for r in records.densified(line).collect())
    n = int(0.007 / (40 / (111_320 * np.cos(np.radians(0.002)))))
    want = [(1, k, *((round(d, 5), 0.0) if (d := 0.007 * k / n) <= 0.003 else (0.003, round(d - 0.003, 5)))) for k in range(n + 1)] + [(2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0)]
    assert len(rows) == len(want) and np.allclose(np.array(rows), np.array(want), atol=1.1e-5)


@pytest.mark.parametrize("longest,want", [(300, [2]), (512, [2]), (1023, [2]), (1024, [2]), (2047, [2]), (2048, [2, 4]), (5000, [2, 4, 8])])
def test_pyramid_factors_agree_with_the_level_table(spark, longest, want):
    from tessera.operators import raster

    catalog = spark.createDataFrame([(1, longest, 100, 10.0)], "raster int, width long, height long, res double")
    levels = sorted(r["k"] for r in raster.level_table(catalog, 2, 256).collect())
    assert raster.factors(longest, 100) == want and levels == list(range(len(want) + 1))


def test_fleet_stream_equals_the_batch(spark, tmp_path):
    rnd = random.Random(4)
    hours = lambda h: f"2024-01-01 {int(h):02d}:{int(h % 1 * 60):02d}:00"
    rows = [(f"h{rnd.randrange(30)}", rnd.choice(["ABC1", " def2 ", "", None]), rnd.choice([" a320", "B7", ""]), f"region{rnd.randrange(3)}", rnd.choice([None, float(rnd.randrange(60))]), float(rnd.randrange(60)), rnd.choice(["ground", "5000", "39000.4", "x", None]), rnd.choice([None, float(rnd.randrange(500))]), rnd.randrange(4), rnd.randrange(3), hours(rnd.random() * 0.15)) for _ in range(300)]
    names = "hex string, cs string, kind string, region string, lat double, lon double, alt_baro string, gs double, flags int, source_rank int, ts "
    events = spark.createDataFrame(rows, names + "string").withColumn("ts", F.col("ts").cast("timestamp"))
    late = spark.createDataFrame([("new", "ABC9", "A1", "region1", 1.0, 1.0, "100", 1.0, 0, 0, hours(3))], names + "string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        events.where(F.pmod(F.hash("hex", "ts", "gs"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def poll():
        stream = spark.readStream.schema(names + "timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        live.fleet_changes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return live.fleet_of(spark.read.parquet(f"{tmp_path}/out"))

    batch = live.first_seen(live.airborne(events))
    fleet = poll()
    for what in (lambda f: live.summary(f, ["ABC", "DEF"], ["region0", "region1", "region2", "region9"]), live.superlatives):
        assert sorted(map(str, what(fleet).collect())) == sorted(map(str, what(batch).collect()))
    assert ("region", "region9", 0) in {tuple(r) for r in live.summary(fleet, [], ["region9"]).collect()}
    for i in range(2):  # the watermark of the first moves, then the others leave
        late.withColumn("gs", F.lit(float(i))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        fleet = poll()
    assert [r["hex"] for r in fleet.collect()] == ["new"]


def test_rides_and_event_places(spark):
    borders = spark.createDataFrame([(1, 2, 10.0), (2, 3, 4.4444), (9, 10, 1.0)], "a long, b long, cost double")
    stations = spark.createDataFrame([(1, 0), (2, 4), (9, 7)], "label long, category int")
    assert sorted(tuple(r) for r in graph.rides(borders, stations).collect()) == [(1, 2, 5.0, 10.0), (2, 3, 13.83, 4.444), (9, 10, None, 1.0)]
    kind = "seq long, event_id long, title string, categories array<string>, geometry array<struct<type: string, coordinates: string>>"
    rows = [(1, 1, None, ["Volcanoes"], [("Point", "[1,2]"), ("Polygon", "[[[3.5,4],[0,0]]]")]), (2, 2, "t", ["Wildfires", "Volcanoes"], [("Point", "[7,8]")]), (3, 3, "t", [], [("Point", "[7,8]")]), (4, 4, "t", ["Wildfires"], []), (5, 5, "t", ["Wildfires"], [("Point", "[]")]), (6, 6, "t", ["Wildfires"], None), (7, 7, "t", None, None)]
    rows += [(100 + i, 100 + i, "w", ["Wildfires"], [("Point", "[1,1]")]) for i in range(130)]
    got = {r["event_id"]: r for r in live.event_groups(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1]["kind"], got[1]["title"], got[1]["lat"], got[1]["lon"]) == ("volcanoes", "", 4.0, 3.5) and (got[2]["kind"], got[2]["lat"], got[2]["lon"]) == ("wildfires", 8.0, 7.0)
    assert set(got) == {1, 2, *range(100, 219)}
