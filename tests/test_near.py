"""Nearest sites and sums within a radius: results of plain Python, and work that doesn't grow with the square."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import graph, hexes, joins, ranking

from .compare import assert_same, database


@pytest.fixture()
def crowded(spark):
    """2,000 points and 4,000 sites: scattered ones, a dense cluster, and 500 at one place."""
    lat, lon = "cast(id * 7919 % 17000 AS double) / 100 - 85 AS {}lat", "cast(id * 104729 % 36000 AS double) / 100 - 180 AS {}lon"
    near = "cast(id * 7919 % 1700 AS double) / 10000 + 50 AS {}lat", "cast(id * 104729 % 3600 AS double) / 10000 + 7 AS {}lon"
    points = spark.range(1000).selectExpr("id", lat.format(""), lon.format("")).union(spark.range(1000, 2000).selectExpr("id", *(x.format("") for x in near)))
    sites = spark.range(2000).selectExpr("id AS site", lat.format("site_"), lon.format("site_")).union(spark.range(2000, 3500).selectExpr("id AS site", *(x.format("site_") for x in near)))
    return points, sites.union(spark.range(3500, 4000).selectExpr("id AS site", "50.1D", "7.1D"))


def met(monkeypatch):
    """How many pairs each search made."""
    own, counts = joins.radius_pairs, []

    def counting(*args, **kwargs):
        pairs = own(*args, **kwargs)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(joins, "radius_pairs", counting)
    return counts


def test_nearest_meets_few_sites(spark, crowded, monkeypatch):
    points, sites = crowded
    counts = met(monkeypatch)
    rows = joins.nearest_k(points.where("id % 40 = 0 OR id < 200"), sites, 3, 2500)
    got = sorted((r["id"], r["rank"], r["site"]) for r in rows.collect())
    points.where("id % 40 = 0 OR id < 200").createOrReplaceTempView("near_points")
    sites.createOrReplaceTempView("near_sites")
    d = "2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(site_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(site_lat)) * pow(sin(radians(site_lon - lon) / 2), 2))))"
    plain = spark.sql(f"SELECT id, rank, site FROM (SELECT id, site, row_number() OVER (PARTITION BY id ORDER BY {d}, site) AS rank FROM near_points CROSS JOIN near_sites) WHERE rank <= 3")
    assert got == sorted((r["id"], r["rank"], r["site"]) for r in plain.collect())
    assert sum(counts) < 100 * len(got)  # 400 and more times as many within 2500 km


def test_nearest_three_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(spark, database(sf), sf, entry.queries()["nearest_three"], entry.oracle_sql()["nearest_three"])


def test_nearest_within_meets_few_sites(spark, crowded, monkeypatch):
    points, sites = crowded
    some = points.where("id % 40 = 0 OR id >= 1800")
    counts = met(monkeypatch)
    got = {r["id"]: (r["site"], r["km"]) for r in joins.nearest_within(some, sites, 1000).collect()}
    assert sum(counts) < 40 * some.count()
    monkeypatch.undo()
    pairs = joins.radius_pairs(some, sites, 1000).groupBy("id").agg(F.min(F.struct("km", "site")).alias("b"))
    assert got == {r["id"]: (r["b"]["site"], r["b"]["km"]) for r in pairs.collect()}


def test_none_within_meets_few_sites(spark, crowded, monkeypatch):
    points, sites = crowded
    some = points.where("id % 40 = 0 OR id >= 1800")
    counts = met(monkeypatch)
    got = {r["id"] for r in joins.none_within(some, sites.where("site > 100"), 300).collect()}
    assert sum(counts) < 40 * some.count()
    monkeypatch.undo()
    near = joins.radius_pairs(some, sites.where("site > 100"), 300).select("id").distinct()
    assert got == {r["id"] for r in some.select("id").exceptAll(near).collect()}


def test_service_kpis_searches_once(spark):
    plan = entry.queries()["service_kpis"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" not in plan  # the search is written, not repeated by each of its readers


def test_radius_counts_make_no_pair_rows(spark, crowded, monkeypatch):
    points, sites = crowded
    some = points.where("id % 20 = 0").unionByName(points.where("id % 40 = 0").withColumn("id", F.col("id") + 10_000)).unionByName(spark.sql("SELECT 99999L AS id, cast(NULL AS double) AS lat, 0D AS lon"))
    pairs = joins.radius_pairs(some, sites, 1500).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    expected = some.select("id").join(pairs, "id", "left").fillna(0).collect()
    monkeypatch.setattr(joins, "GROUP_ROWS", 50)
    monkeypatch.setattr(joins, "GROUP_OTHERS", 700)
    counts = met(monkeypatch)
    got = joins.radius_counts(some, sites, 1500).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
    assert not counts


def test_site_scores_make_no_pair_rows(spark, crowded, monkeypatch):
    points, sites = crowded
    some = sites.where("site % 20 = 0 OR site > 3900")
    pairs = joins.radius_pairs(points, some, 1200).groupBy("site").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) + F.avg(1 - F.col("km") / 1200) * 0.5).alias("score"))
    expected = {r["site"]: (r["n"], round(r["score"], 5)) for r in pairs.collect()}
    counts = met(monkeypatch)
    got = {r["site"]: (r["captured"], round(r["score"], 5)) for r in ranking.site_scores(points, some, 1200).collect()}
    assert got == expected
    assert not counts


def test_a_search_ends_at_its_goal(spark):
    up = spark.range(2, 3000).selectExpr("id AS src", "id div 2 AS dst", "cast(1 + id % 5 AS double) AS cost")
    edges = up.unionByName(up.selectExpr("dst AS src", "src AS dst", "cost"))
    start = spark.sql("SELECT 150L AS node, 0D AS cost, 150L AS label")
    paths = graph.shortest(edges, start, targets=spark.sql("SELECT 37L AS node")).collect()
    assert {r["node"]: r["cost"] for r in paths}[37] == 2.0  # 150 to 75 to 37, one each
    assert len(paths) < 20 and max(r["cost"] for r in paths) <= 2.0


def test_equal_polygons_are_cut_once(spark, monkeypatch):
    ring = "array(named_struct('x', x, 'y', y), named_struct('x', x + 3, 'y', y), named_struct('x', x, 'y', y + 4)) AS ring"
    one = spark.range(3).selectExpr("id", "id * 1D AS x", "id * 0.5D AS y").selectExpr("id", ring)
    many = spark.range(300).selectExpr("id", "id % 3 * 1D AS x", "id % 3 * 0.5D AS y").selectExpr("id", ring)
    areas = {(r["id"], r["other"]): r["area_m2"] for r in hexes.overlay(one, one).collect()}
    cut, sizes = graph.cut, []

    def counting(df):
        table = cut(df)
        sizes.append(table.count() if "_m2" in table.columns else 0)
        return table

    monkeypatch.setattr(graph, "cut", counting)
    got = {(r["id"], r["other"]): r["area_m2"] for r in hexes.overlay(many, many.where("id % 4 = 0")).collect()}
    assert got == {(a, b): areas[a % 3, b % 3] for a in range(300) for b in range(0, 300, 4) if (a % 3, b % 3) in areas}
    assert max(sizes) == len(areas)


def test_equal_polygons_are_filled_once(spark, monkeypatch):
    ring = "array(named_struct('x', x, 'y', 1D), named_struct('x', x + 3, 'y', 1D), named_struct('x', x, 'y', 5D)) AS ring"
    many = spark.range(200).selectExpr("id", "id % 2 * 1D AS x").selectExpr("id", ring)
    cut, sizes = graph.cut, []

    def counting(df):
        table = cut(df)
        sizes.append(table.count() if "ring" in table.columns else 0)
        return table

    monkeypatch.setattr(graph, "cut", counting)
    rows = hexes.polyfill(many, 3).collect()
    own = {i: sorted(r["cell"] for r in rows if r["id"] == i) for i in range(200)}
    assert own[0] and own[1] and own[0] != own[1] and all(own[i] == own[i % 2] for i in own)
    assert max(sizes) == 2


def test_mismatch_is_many_tasks(spark):
    base = spark.range(40).selectExpr(f"{(1 << 59) | (2 << 52) | ((1 << 39) - 1)} | shiftleft(id + 20, 45) | shiftleft(id % 7, 42) | shiftleft(id % 5, 39) AS cell")
    rows = hexes.mismatch(base).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 40 and len({r["task"] for r in rows}) > 1


def gridded(spark, n, m):
    """n points about two grid points and one without a latitude, m rows of series at either, some nowhere."""
    points = spark.range(n).selectExpr("id", "CASE WHEN id <> 5 THEN id % 3 * 4D - 4 END AS lat", "id % 2 * -7D AS lon")
    axes = {"lat": spark.sql("SELECT i AS index, i * 10D - 10 AS value FROM (SELECT explode(sequence(0L, 2L)) AS i)"), "lon": spark.sql("SELECT i AS index, i * 20D AS value FROM (SELECT explode(sequence(0L, 18L)) AS i)")}
    return points, axes, spark.range(m).selectExpr("id AS event", "rand(7) AS value", "CASE WHEN id % 9 > 0 THEN 1L END AS lat_index", "id % 2 * 18 AS lon_index")


def test_gridded_series_holds_points_as_a_pattern(spark, monkeypatch, tmp_path):
    points, axes, series = gridded(spark, 100, 45_000)
    monkeypatch.setattr(joins, "LIST_ROWS", 1 << 16, raising=False)
    joins.nearest_on_axes(points, axes, series).select("id", "lat_index", "lon_index", "event", "value").write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == rows.distinct().count() == 99 * 20_000
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < rows.count()  # 12 bytes a row, point by point


@pytest.mark.parametrize("lists, made", [(256, 1 << 22), (7, 50)])
def test_gridded_series_has_all_pairs(spark, monkeypatch, lists, made):
    monkeypatch.setattr(joins, "LIST_POINTS", lists, raising=False)
    monkeypatch.setattr(joins, "LIST_ROWS", made, raising=False)
    points, axes, series = gridded(spark, 100, 90)
    got = joins.nearest_on_axes(points, axes, series)
    events = series.collect()
    at = {r["id"]: (0 if r["lat"] is None else 1, 18 if r["lon"] else 0) for r in points.collect()}
    expected = sorted((i, *cell, e["event"], e["value"]) for i, cell in at.items() for e in events if (e["lat_index"], e["lon_index"]) == cell)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["id"], r["lat_index"], r["lon_index"], r["event"], r["value"]) for r in rows) == expected
    assert {(r["lat_grid"], r["lon_grid"]) for r in rows} == {(0.0, 0.0), (0.0, 360.0)}
    assert lists > 7 or len({r["task"] for r in rows}) > 2


def test_gridded_series_has_tasks_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "LIST_POINTS", 7)
    monkeypatch.setattr(joins, "LIST_ROWS", 50)
    monkeypatch.setattr(joins, "TASK_ROWS", 40, raising=False)
    points, axes, series = gridded(spark, 100, 90)
    tasks = lambda: len({r["task"] for r in joins.nearest_on_axes(points, axes, series).select(F.spark_partition_id().alias("task")).collect()})
    many = tasks()
    monkeypatch.setattr(joins, "TASK_ROWS", 1 << 26, raising=False)
    assert many > 16 >= tasks()  # 4 threads make 16 parts of any number of rows
