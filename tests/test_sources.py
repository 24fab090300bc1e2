"""Sources and sinks: pruning, catalogs, places, remote queries, exports; versioned tables that die while written."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.operators import joins, versioned
from tessera.sources import io


def test_box_scan_reaches_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    box = F.struct(*((F.col("id") + float(d)).alias(n) for d, n in enumerate(("xmin", "xmax", "ymin", "ymax"))))
    spark.range(100).select("id", box.alias("bbox"), F.lit("x" * 50).alias("unused")).write.parquet(path)
    df = io.box_scan(spark, path, (10.0, 0.0, 12.0, 100.0), ["id"])
    assert sorted(r["id"] for r in df.collect()) == [9, 10, 11, 12]
    plan = df._jdf.queryExecution().toString()
    assert "unused" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(bbox" in plan


def test_catalog_reads_only_overlapping_files(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"file://{tmp_path}/f{i}")
    catalog = spark.createDataFrame([(f"file://{tmp_path}/f{i}", i * 10.0, 0.0, i * 10.0 + 9, 1.0) for i in range(3)], "path string, w double, s double, e double, n double")
    df = io.catalog_scan(spark, catalog, (12.0, 0.0, 15.0, 1.0), "id long")
    assert df.count() == 10 and all("/f1/" in f for f in df.inputFiles())
    assert io.catalog_scan(spark, catalog, (200.0, 0.0, 201.0, 1.0), "id long").count() == 0
    with pytest.raises(ValueError):
        io.catalog_paths(catalog, (0.0, 0.0, 99.0, 1.0), most=2)


def test_coarse_cells_prune_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = spark.range(400).select("id", cells.at(F.col("id") % 160 - 80.0, F.col("id") * 7.0 % 360 - 180, 5).alias("cell"))
    io.write_by_coarse_cell(rows, path, "cell")
    one = rows.first()["cell"]
    df = spark.read.parquet(path).where(F.col("cell0") == cells.parent(F.lit(one), 0))
    assert "PartitionFilters: [isnotnull(cell0" in df._jdf.queryExecution().toString()
    assert df.where(F.col("cell") == one).count() >= 1 and spark.read.parquet(path).count() == 400


def test_places_take_the_first_line(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("".join(f"z{i}\tname{i}\t{10 + i % 3}.00001\t{20 + i % 3}\n" for i in range(9)) + "short\n")
    (tmp_path / "b.tsv").write_text("y\tlater\t10.0\t20\nx\tbad\tn/a\t1\n")
    rows = {r["name"] for r in io.tab_places(spark, f"file://{tmp_path}/*.tsv", 4, 2, 3, 1).collect()}
    assert rows == {"name0", "name1", "name2"}


def test_remote_query_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(50).select("id", (F.col("id") * 2).alias("n")).write.jdbc(url, "T")
    query = 'SELECT "id", "n" FROM T WHERE "n" > 10'
    whole = io.jdbc(spark, url, query)
    parts = io.jdbc(spark, url, query, split=("id", 0, 50, 4))
    assert (whole.rdd.getNumPartitions(), parts.rdd.getNumPartitions()) == (1, 4)
    assert sorted(r["id"] for r in parts.collect()) == sorted(r["id"] for r in whole.collect()) == list(range(6, 50))


def test_csv_export(spark, tmp_path):
    io.write_csv(spark.createDataFrame([(1, 'a,"b"'), (2, None)], "rank int, name string").coalesce(1), f"file://{tmp_path}/o")
    text = next((tmp_path / "o").glob("part-*.csv")).read_text().splitlines()
    assert text[0] == "rank,name" and len(text) == 3
    assert [tuple(r) for r in spark.read.csv(f"file://{tmp_path}/o", header=True, inferSchema=True).orderBy("rank").collect()] == [(1, 'a,"b"'), (2, None)]


def test_snapshots_that_died_are_not_current(spark, tmp_path):
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t")
    t.create("id string, pos long, n int")
    t.append(spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "id string, pos long, n int"))
    dead = tmp_path / "t" / "snapshot_ts=99999999T000000000000Z"
    dead.mkdir()
    (dead / "part-0.parquet").write_bytes(b"half")
    assert len(t.history()) == 2 and t.latest().count() == 2
    with pytest.raises(ValueError):
        t.update(spark.createDataFrame([("a", 5), ("a", 6)], "id string, n int"))
    t.rename_column("n", "m")
    t.drop_column("m")
    assert t.latest().columns == ["id", "pos"] and len(t.history()) == 4


def test_as_of_is_the_same_in_buckets(spark):
    rows = spark.range(600).selectExpr("id", "id % 3 AS k", "id * 37 % 500 AS t")
    rates = spark.range(90).selectExpr("id % 3 AS k", "id * 53 % 700 AS t", "CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS v")
    out = lambda b: {r["id"]: r["v"] for r in joins.as_of(rows, rates, ["k"], "t", "v", b).collect()}
    assert out(None) == out(F.floor(F.col("t") / 60)) and len(set(out(None).values())) > 20


def test_encodings_of_cells(spark, tmp_path):
    rows = spark.range(2000).select(cells.at(F.col("id") % 160 - 80.0, F.col("id") * 7.0 % 360 - 180, 9).alias("cell"), "id")
    sizes = io.write_encodings(rows, f"file://{tmp_path}/e", "cell")
    assert 0 < sizes["int"] < sizes["text"]
    back = spark.read.parquet(f"file://{tmp_path}/e/text").select(cells.from_text(F.col("cell")).alias("cell"), "id")
    assert back.exceptAll(rows).count() == 0 and back.count() == 2000
