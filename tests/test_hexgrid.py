"""The hexagon grid against published cells, and against what a grid must be."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cells, geo, hexgrid
from tessera.operators import hexes

#: Published cells with their corners (lon, lat), and centres (lat, lon) and km2 of base cells.
CORNERS = {
    "8919695264fffff": [(4.89666, 52.361801), (4.896982, 52.360212), (4.899528, 52.359743), (4.901753, 52.360862), (4.901432, 52.362451), (4.898885, 52.362921)],
    "8a1ea541b0effff": [(12.333007, 45.429457), (12.332729, 45.428795), (12.333421, 45.428329), (12.33439, 45.428524), (12.334667, 45.429186), (12.333976, 45.429653)],
    "892a1008b27ffff": [(-73.984383, 40.770232), (-73.986487, 40.769294), (-73.986418, 40.767533), (-73.984245, 40.76671), (-73.982141, 40.767648), (-73.98221, 40.769409)],
}
BASE = {"8001fffffffffff": (79.242, 38.023, 4106166), "8009fffffffffff": (64.7, 10.536, 2562182), "8075fffffffffff": (2.301, -5.245, 2562182), "80f3fffffffffff": (-79.242, -141.977, 4106166)}


def everywhere(n, seed=1):
    v = np.random.default_rng(seed).standard_normal((n, 3))
    return hexgrid.degrees_of(v / np.linalg.norm(v, axis=1, keepdims=True))


def test_published_cells():
    for name, corners in CORNERS.items():
        cell = np.array([int(name, 16)])
        lat, lon = hexgrid.degrees_of(hexgrid.boundary_of(cell)[0])
        assert np.allclose(np.stack([lon, lat], 1), corners, atol=1e-6), name
        assert hexgrid.cell_of(*hexgrid.center_of(cell), (cell[0] >> 52) & 15) == cell
    for name, (lat, lon, km2) in BASE.items():
        cell = np.array([int(name, 16)])
        assert np.allclose(np.array(hexgrid.center_of(cell)).ravel(), (lat, lon), atol=1e-3)
        assert round(hexgrid.area_of(cell)[0] / 1e6) == km2 and hexgrid.cell_of(np.array([lat]), np.array([lon]), 0) == cell


@pytest.mark.parametrize("res", range(16))
def test_centres_lie_in_their_cells(res):
    lat, lon = everywhere(20_000, res)
    cell = hexgrid.cell_of(lat, lon, res)
    assert (hexgrid.cell_of(*hexgrid.center_of(cell), res) == cell).all()
    far = np.linalg.norm(hexgrid.unit_vector(*map(np.radians, hexgrid.center_of(cell))) - hexgrid.unit_vector(np.radians(lat), np.radians(lon)), axis=1)
    assert far.max() * np.sqrt(7.0) ** res < 0.23


@pytest.mark.parametrize("res,n", [(1, 842), (2, 5882)])
def test_cells_tile_the_sphere(res, n):
    every = np.unique(hexgrid.cell_of(*everywhere(500_000), res))
    assert len(every) == n
    assert np.isclose(hexgrid.area_of(every).sum(), 4 * np.pi * (hexgrid.EARTH_KM * 1000) ** 2, rtol=1e-9)
    near = dict(zip(every.tolist(), (set(x.tolist()) for x in hexgrid.neighbours_of(every))))
    assert sorted(map(len, near.values())).count(5) == 12 and all(c in near[o] for c, others in near.items() for o in others)


def test_columns_and_nulls(spark):
    rows = spark.createDataFrame([(1, 52.3613, 4.8992), (2, None, 1.0), (3, float("nan"), 0.0)], "id int, lat double, lon double")
    out = rows.withColumn("cell", cells.at(F.col("lat"), F.col("lon"), 9)).withColumn("c", cells.center(F.col("cell"))).withColumn("ring", cells.boundary(F.col("cell"))).withColumn("m2", cells.area_m2(F.col("cell"))).orderBy("id").collect()
    assert format(out[0]["cell"], "x") == "8919695264fffff" and len(out[0]["ring"]) == 7 and 60_000 < out[0]["m2"] < 150_000
    assert all(r[c] is None for r in out[1:] for c in ("cell", "c", "ring", "m2"))


def triangles(spark):
    rows = [(i, [(x, y), (x + 12, y), (x, y + 15)]) for i in range(25) for x, y in ((-60.0 + i * 5, -40.0 + i * 2),)]
    return spark.createDataFrame(rows, "id long, ring array<struct<x: double, y: double>>")


def test_fills_hold_every_centre_inside(spark):
    every = np.unique(hexgrid.cell_of(*everywhere(3_000_000, 3), 3))
    lat, lon = hexgrid.center_of(every)
    zones = triangles(spark)
    rows = spark.createDataFrame([(int(c), float(a), float(b)) for c, a, b in zip(every, lat, lon)], "cell long, lat double, lon double")
    want = rows.join(F.broadcast(zones), geo.ring_contains(F.col("ring"), F.col("lon"), F.col("lat"))).select("id", "cell")
    own = hexes.polyfill(zones, 3)
    assert {tuple(r) for r in own.collect()} == {tuple(r) for r in want.collect()} and own.count() > 500
    report = {r["id"]: r for r in hexes.fill_report(zones, 4).collect()}
    assert len(report) == 25 and all(0.9 < r["coverage"] < 1.1 for r in report.values())
    mean = {r["cell"]: r for r in hexes.carried_mean(zones.withColumn("v", F.col("id") * 10), zones.where("id = 4"), 3, "v").collect()}
    inside = {r["cell"] for r in want.where("id = 4").collect()}
    held = {}
    for r in want.collect():
        held.setdefault(r["cell"], []).append(r["id"] * 10)
    assert set(mean) == inside and all(mean[c]["mean"] == sum(held[c]) / len(held[c]) for c in inside)


def test_children_against_parents(spark):
    ids = [int(x, 16) for x in (*CORNERS, "8009fffffffffff", "8001fffffffffff")]
    df = spark.createDataFrame([(i,) for i in ids], "cell long")
    for r in hexes.mismatch(df).collect():
        assert 0.97 < r["area_ratio"] < 1.03 and 0 <= r["leak_pct"] < 12 and 0 <= r["gap_pct"] < 12
        if r["cell"] == ids[0]:
            assert abs(abs(r["twist_deg"]) - 19.1) < 1
    tree = {r["cell"]: r for r in hexes.descent(spark.createDataFrame([(int("8009fffffffffff", 16),), (int("8001fffffffffff", 16),)], "cell long"), 0).collect()}
    assert sorted(len(r["children"]) for r in tree.values()) == [6, 7] and sorted(r["pentagon"] for r in tree.values()) == [False, True]
    drift = hexes.area_drift(df.where("cell > 0")).collect()
    assert {r["res"] for r in drift} == {0, 9, 10}
