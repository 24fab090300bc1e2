"""Fills from coarse to fine, holes, poles, overlays and means against all cells of the grid and plain geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cells, geo, hexgrid
from tessera.operators import aggregates, flood, hexes, ranking

RING = "array<struct<x: double, y: double>>"


@pytest.fixture(scope="module")
def every():
    """All cells of resolution 3 with their centres."""
    v = np.random.default_rng(1).standard_normal((1_500_000, 3))
    ids = np.unique(hexgrid.cell_of(*hexgrid.degrees_of(v / np.linalg.norm(v, axis=1, keepdims=True)), 3))
    assert len(ids) == 2 + 120 * 7**3
    return ids, *hexgrid.center_of(ids)


def contains(ring, x, y):
    inside = np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def filled(spark, rows, res=3):
    df = spark.createDataFrame(rows, f"id long, ring {RING}, holes array<{RING}>")
    out = {}
    for r in hexes.polyfill(df, res).collect():
        out.setdefault(r["id"], set()).add(r["cell"])
    return out


def test_holes_poles_and_the_antimeridian(spark, every):
    ids, lat, lon = every
    country = [(-10.0, -30.0), (40.0, -35.5), (55.0, 20.0), (20.0, 44.0), (5.0, 10.0), (-14.0, 30.0)]
    lake, island = [(5.0, -20.0), (30.0, -22.0), (28.0, 5.0), (8.0, 3.0)], [(12.0, -15.0), (22.0, -15.0), (18.0, -5.0)]
    pacific = [(160.0, -20.0), (205.0, -25.0), (200.0, 15.0), (165.0, 12.0)]
    arctic = [(float(x), float(66.0 + 9 * np.sin(np.radians(3 * x)))) for x in range(-180, 181, 10)]
    antarctic = [(x, -y + 2.0) for x, y in arctic]
    got = filled(spark, [(1, country, [lake, island]), (2, country, None), (3, pacific, []), (4, arctic, None), (5, antarctic, None), (6, island, None), (6, lake, None), (7, country[:2], None)])
    as_set = lambda mask: set(ids[mask].tolist())
    inside = contains(country, lon, lat)
    assert got[1] == as_set(inside ^ contains(lake, lon, lat) ^ contains(island, lon, lat)) and got[2] == as_set(inside) and got[1] < got[2]
    assert got[3] == as_set(contains(pacific, lon, lat) | contains(pacific, lon + 360, lat))
    line = lambda x: 66.0 + 9 * np.sin(np.radians(3 * x))
    edge = np.interp(lon, [p[0] for p in arctic], [p[1] for p in arctic])
    assert got[4] == as_set(lat > edge) and got[5] == as_set(lat < 2 - edge) and line(0) == 66
    assert got[6] == as_set(contains(lake, lon, lat)) | as_set(contains(island, lon, lat)) and 7 not in got


def test_ranges_cover_the_fill_and_follow_the_border(spark, every):
    ring = [(-10.0, -30.0), (40.0, -35.5), (55.0, 20.0), (20.0, 44.0)]
    df = spark.createDataFrame([(1, ring)], f"id long, ring {RING}")
    fill = hexes.refined(df, 6).cache()
    ranges = sorted((r["low"], r["high"]) for r in hexes.cell_ranges(fill, 6).collect())
    cells_6 = sorted(r["cell"] for r in hexes.expanded(fill, 6).select("cell").collect())
    ids = np.array(cells_6)
    lat, lon = hexgrid.center_of(ids)
    assert len(np.unique(ids)) == len(ids) and contains(ring, lon, lat).all() and len(ranges) < len(ids) / 5
    assert all(a < b for (_, a), (b, _) in zip(ranges, ranges[1:]))
    at = np.searchsorted([r[0] for r in ranges], ids, side="right") - 1
    assert all(ranges[i][0] <= c <= ranges[i][1] for i, c in zip(at, cells_6))
    coarse = {c for c, a, b in zip(every[0].tolist(), *every[1:]) if contains(ring, np.array([b]), np.array([a]))[0]}
    assert {r["cell"] for r in hexes.polyfill(df, 3).collect()} == coarse
    assert fill.groupBy(F.spark_partition_id()).count().count() > 1
    fill.unpersist()


def test_reach_holds_all_centres_below():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((200_000, 3))
    lat, lon = hexgrid.degrees_of(v / np.linalg.norm(v, axis=1, keepdims=True))
    point = lambda c: hexgrid.unit_vector(*map(np.radians, hexgrid.center_of(c)))
    for res in range(5):
        fine = np.unique(hexgrid.cell_of(lat, lon, res + 4))
        up = lambda r: (fine | cells._mask(r)) & ~(15 << 52) | (r << 52)
        far = lambda a, b: np.degrees(2 * np.arcsin(np.linalg.norm(point(a) - point(b), axis=1) / 2)).max()
        assert far(fine, up(res)) < hexes.reach_degrees(res)
        assert far(up(res + 1), up(res)) + hexes.reach_degrees(res + 1) < hexes.reach_degrees(res)


def test_cells_beside_nulls_stay_exact(spark):
    rows = spark.createDataFrame([(0x8919695264FFFFF,), (None,), (0x8A1EA541B0EFFFF,)], "cell long").coalesce(1)
    out = rows.select("cell", cells.center(F.col("cell")).alias("c"), cells.boundary(F.col("cell")).alias("r")).collect()
    for row in out:
        if row["cell"] is None:
            assert row["c"] is None and row["r"] is None
        else:
            lat, lon = (float(x[0]) for x in hexgrid.center_of(np.array([row["cell"]])))
            assert (row["c"]["lat"], row["c"]["lon"]) == (lat, lon) and len(row["r"]) == 7


def test_overlay_of_polygons_that_are_not_convex(spark):
    star = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)]
    other = [(1.0, 2.5), (3.0, 2.5), (3.0, -1.0), (2.0, 0.5), (1.0, -1.0)]
    lone = [(50.0, 50.0), (51.0, 50.0), (51.0, 51.0)]
    left = spark.createDataFrame([(1, star), (2, lone), (3, star[::-1])], f"id long, ring {RING}")
    right = spark.createDataFrame([(9, other), (8, lone[:2])], f"id long, ring {RING}")
    got = {(r["id"], r["other"]): r["area_m2"] for r in hexes.overlay(left, right, 1.5).collect()}
    n = 1200
    x, y = (v.ravel() for v in np.meshgrid((np.arange(4 * n) + 0.5) / n, (np.arange(4 * n) + 0.5) / n - 1))
    both = contains(star, x, y) & contains(other, x, y)
    plain = both.sum() / n**2 * (np.radians(1) * geo.EARTH_KM * 1000) ** 2
    assert got.keys() == {(1, 9), (3, 9)} and all(abs(v / plain - 1) < 3e-3 for v in got.values())


def test_means_and_reports(spark):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    zones = spark.createDataFrame([(1, square(0.0, 0.0, 8.0), 10.0), (2, square(4.0, 0.0, 8.0), 40.0), (3, square(0.0, 0.0, 9.0), None)], f"id long, ring {RING}, income double")
    area = spark.createDataFrame([(7, square(2.0, 0.0, 6.0))], f"id long, ring {RING}")
    rows = {r["cell"]: r for r in hexes.carried_mean(zones, area, 4, "income").collect()}
    share = {r["id"]: r["area_m2"] for r in hexes.overlay(zones.select("id", "ring"), area).collect()}
    for cell, row in rows.items():
        lat, lon = (float(x[0]) for x in hexgrid.center_of(np.array([cell])))
        assert 2 < lon < 8 and 0 < lat < 6
        if lon > 4:
            assert row["n"] == 2 and row["mean"] == 25 and abs(row["area_mean"] - (10 * share[1] + 40 * share[2]) / (share[1] + share[2])) < 1e-9
        else:
            assert row["n"] == 1 and row["mean"] == 10 and abs(row["area_mean"] - 10) < 1e-9
    assert len({r["n"] for r in rows.values()}) == 2
    report = {r["id"]: r for r in hexes.fill_report(zones.select("id", "ring"), 5).collect()}
    fills = {r["id"]: r["count"] for r in hexes.polyfill(zones, 5).groupBy("id").count().collect()}
    for i, r in report.items():
        own = np.array([x["cell"] for x in hexes.polyfill(zones.where(f"id = {i}"), 5).collect()])
        assert r["n_cells"] == fills[i] == len(own) and np.isclose(r["hex_m2"], hexgrid.area_of(own).sum(), rtol=1e-12) and abs(r["coverage"] - 1) < 0.02


def test_scattered_parents_skip_what_lies_between(spark, tmp_path):
    every = (np.int64(1) << 59) | (np.int64(5) << 52) | (np.arange(122, dtype=np.int64) << 45) | ((np.int64(1) << 45) - 1)
    base = spark.createDataFrame([(int(c),) for c in every], "cell long")
    fine = base.selectExpr("cell", "explode(sequence(0, 48)) k")
    rows = fine.selectExpr("(cell & ~(63L << 39)) | (cast(k div 7 as bigint) << 42) | (cast(k % 7 as bigint) << 39) cell")
    rows.orderBy("cell").coalesce(1).write.option("parquet.block.size", "1024").option("parquet.page.size", "256").parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    at = lambda b: int(every[b] & ~(15 << 52) | (1 << 52)) & ~(7 << 42)
    parents = spark.createDataFrame([(at(3),), (at(110),), (None,), (at(3),)], "parent long")
    assert len(hexes.covering_ranges(parents, 1, 5)) == 2
    found = hexes.under(table, "cell", parents, 1, 5)
    assert found.count() == 14
    pushed = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in pushed and "Or(" in pushed
    # neighbours are one range, and very many parents are covered by coarser cells
    near = spark.createDataFrame([(at(7) | d << 42,) for d in range(3)], "parent long")
    assert len(hexes.covering_ranges(near, 1, 5)) == 1
    many = rows.select(cells.parent(F.col("cell"), 2).alias("parent"))
    assert 1 <= len(hexes.covering_ranges(many, 2, 5)) <= hexes.RANGES and hexes.under(table, "cell", many, 2, 5).count() == 122 * 49
    assert hexes.under(table, "cell", parents.where("parent is null"), 1, 5).count() == 0


def test_parallel_picks_equal_one_by_one(spark):
    rnd = np.random.default_rng(8)
    for n, km, k in ((300, 900.0, 12), (150, 4000.0, 500), (200, 30.0, 200)):
        v = rnd.standard_normal((n, 3))
        lat, lon = hexgrid.degrees_of(v / np.linalg.norm(v, axis=1, keepdims=True))
        score = rnd.integers(0, 40, n)
        df = spark.createDataFrame([(i, float(a), float(b), float(s)) for i, (a, b, s) in enumerate(zip(lat, lon, score))], "id long, lat double, lon double, score double")
        want: list[int] = []
        a, b = np.radians(lat), np.radians(lon)
        far = lambda i, j: 2 * geo.EARTH_KM * np.arcsin(min(1.0, np.sqrt(np.sin((a[i] - a[j]) / 2) ** 2 + np.cos(a[i]) * np.cos(a[j]) * np.sin((b[i] - b[j]) / 2) ** 2)))
        for i in sorted(range(n), key=lambda i: (-score[i], i)):
            if len(want) < k and all(far(i, j) > km for j in want):
                want.append(i)
        got = ranking.greedy_apart(df, "score", km, k).orderBy("pick").collect()
        assert [r["id"] for r in got] == want and [r["pick"] for r in got] == list(range(1, len(want) + 1))
    assert ranking.greedy_apart(df.limit(0), "score", 5.0, 3).count() == 0


def test_rasterised_polygons_with_holes(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for i in range(6):
        turn = np.sort(rnd.uniform(0, 2 * np.pi, 9))
        ring = [(float(x), float(y)) for x, y in zip(20 + 3 * i + rnd.uniform(3, 9, 9) * np.cos(turn), 20 + rnd.uniform(3, 9, 9) * np.sin(turn))]
        hole = [(20.3 + 3 * i + a, 19.7 + b) for a, b in ((0.0, 0.0), (2.0, 0.1), (1.0, 1.9))]
        rows.append((ring, [hole] if i % 2 else None))
    got = {tuple(r) for r in flood.polygon_cells(spark.createDataFrame(rows, f"ring {RING}, holes array<{RING}>"), 0.0, 40.0, 0.7).collect()}
    fine = 0.7 / 3
    r, c = (v.ravel() for v in np.meshgrid(np.arange(180), np.arange(240), indexing="ij"))
    x, y = (c + 0.5) * fine, 40 - (r + 0.5) * fine
    any_ = np.zeros(len(x), bool)
    for ring, holes in rows:
        own = contains(ring, x, y)
        for hole in holes or []:
            own ^= contains(hole, x, y)
        any_ |= own
    n: dict = {}
    for a, b in zip(r[any_] // 3, c[any_] // 3):
        n[a, b] = n.get((a, b), 0) + 1
    assert got == {at for at, k in n.items() if k / 9 >= 0.45}


def test_merged_sketches_keep_their_bounds(spark):
    rnd = np.random.default_rng(9)
    rows = [(int(hexgrid.cell_of(np.array([a]), np.array([b]), 4)[0]), float(v), int(i)) for a, b, v, i in zip(rnd.uniform(40, 50, 4000), rnd.uniform(0, 20, 4000), rnd.normal(size=4000), rnd.integers(0, 900, 4000))]
    df = spark.createDataFrame(rows, "cell long, v double, id long")
    table = aggregates.cell_sketches(df, "cell", "v", "id").cache()
    found = aggregates.sketched_stats(aggregates.merged_sketches(table, (0, 2)), (0.25, 0.5, 0.9)).collect()
    for r in found:
        up = lambda c: c | cells._mask(r["res"]) & ~0
        own = [x for x in rows if (up(x[0]) & ~(15 << 52)) | (r["res"] << 52) == r["parent"]]
        values = np.sort([x[1] for x in own])
        assert r["n"] == len(own) and abs(r["distinct"] - len({x[2] for x in own})) <= aggregates.HLL_ERROR * r["distinct"]
        for t, q in zip((0.25, 0.5, 0.9), r["q"]):
            assert abs(np.searchsorted(values, q) / len(values) - t) <= 3 * aggregates.KLL_RANK_ERROR + 1 / len(values)
    assert sum(r["n"] for r in found if r["res"] == 2) == 4000
    none = aggregates.cell_sketches(df.withColumn("v", F.lit(None).cast("double")), "cell", "v", "id")
    assert all(r["q"] is None for r in aggregates.sketched_stats(aggregates.merged_sketches(none, (0,))).collect())
    table.unpersist()
