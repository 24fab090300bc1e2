"""Scans and sinks: pruned Parquet, catalogs, delimited text, GeoJSON, header-row JSON, sorted sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box_scan(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: Sequence[str]) -> DataFrame:
    """Columns of the rows whose bbox struct overlaps a box; filter and nested fields reach the Parquet scan."""
    w, s, e, n = box
    rows = spark.read.parquet(path)
    return rows.where((F.col("bbox.xmin") <= e) & (F.col("bbox.xmax") >= w) & (F.col("bbox.ymin") <= n) & (F.col("bbox.ymax") >= s)).select(*columns)


def catalog_paths(catalog: DataFrame, box: tuple[float, float, float, float], most: int = 100_000) -> list[str]:
    """The files of a catalog (path, w, s, e, n) that overlap a box: names only, at most `most`."""
    w, s, e, n = box
    rows = catalog.where((F.col("w") <= e) & (F.col("e") >= w) & (F.col("s") <= n) & (F.col("n") >= s)).select("path").orderBy("path").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} files overlap the box")
    return [r["path"] for r in rows]


def catalog_scan(spark: SparkSession, catalog: DataFrame, box: tuple[float, float, float, float], schema: T.StructType | str) -> DataFrame:
    paths = catalog_paths(catalog, box)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def numbers_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as doubles, null where they aren't numbers."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def units_csv(spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str], marker: Column) -> DataFrame:
    """CSV with a header and a units row (where `marker` is true), named columns, numbers or null."""
    return numbers_or_null(spark.read.csv(path, header=True).where(~F.coalesce(marker, F.lit(False))).select(*columns), numeric)


def piped(spark: SparkSession, path: str, key: str, prefix: str, value: str, missing_below: float = 0) -> DataFrame:
    """Pipe-delimited national table: keys with a prefix, their last part, sentinel values dropped."""
    rows = spark.read.csv(path, header=True, sep="|").where(F.col(key).startswith(prefix))
    return rows.select(F.element_at(F.split(key, "US"), -1).alias("id"), F.col(value).try_cast("double").alias("value")).where(F.col("value") >= missing_below)


def tab_places(spark: SparkSession, path: str, least_fields: int, lat: int, lon: int, name: int, digits: int = 3) -> DataFrame:
    """Tab-separated places with enough fields, one for each rounded coordinate: the first line's, by file name and
    place in the file."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"), place.alias("line")).where(F.size("f") >= least_fields)
    rows = rows.select(F.col("f")[name].alias("name"), F.col("f")[lat].try_cast("double").alias("lat"), F.col("f")[lon].try_cast("double").alias("lon"), "line").where("lat is not null and lon is not null")
    first = F.min_by(F.struct("name", "lat", "lon"), F.col("line"))
    return rows.groupBy(F.round("lat", digits).alias("_y"), F.round("lon", digits).alias("_x")).agg(first.alias("p")).select("p.*")


FEATURES = "type string, features array<struct<type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature: properties (map) and geometry (type and coordinates as JSON text)."""
    return spark.read.schema(FEATURES).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")


def outer_rings(features: DataFrame) -> DataFrame:
    """The outer rings of Polygon and MultiPolygon coordinates, rings of fewer than four points dropped."""
    rings = "array<array<array<double>>>"
    poly = F.from_json("coordinates", rings)
    multi = F.from_json("coordinates", f"array<{rings}>")
    outer = F.when(F.col("type") == "Polygon", F.array(poly[0])).when(F.col("type") == "MultiPolygon", F.transform(multi, lambda p: p[0]))
    ring = F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return features.withColumn("r", F.explode(F.filter(outer, lambda r: F.size(r) >= 4))).withColumn("ring", ring).drop("r", "coordinates")


def header_rows(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """A JSON array of rows whose first row is the header: named columns by header position."""
    rows = df.select(F.from_json(column, "array<array<string>>").alias("a"))
    at = {n: F.array_position(F.col("a")[0], n) for n in names}
    return rows.select("a", F.posexplode("a").alias("i", "r")).where("i > 0").select(*(F.element_at("r", at[n].cast("int")).alias(n) for n in names))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of frames with different columns; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_sorted(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Zstd Parquet in range partitions sorted by key: later scans prune row groups by min and max."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """The size of the files in a folder, as its file system tells."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(where).getLength()


def write_encodings(df: DataFrame, path: str, cell: str) -> dict[str, int]:
    """The table sorted by cell, with the cells as numbers (path/int) and as text (path/text), and the bytes of both."""
    from ..functions.cells import to_text

    write_sorted(df, f"{path}/int", cell)
    write_sorted(df.withColumn(cell, to_text(F.col(cell))), f"{path}/text", cell)
    return {name: folder_bytes(df.sparkSession, f"{path}/{name}") for name in ("int", "text")}


def write_by_coarse_cell(df: DataFrame, path: str, cell: str, res: int = 0) -> None:
    """Partitions by the parent cell at a coarse resolution, for partition pruning."""
    from ..functions.cells import parent

    df.withColumn("cell0", parent(F.col(cell), res)).repartition("cell0").write.partitionBy("cell0").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def jdbc(spark: SparkSession, url: str, query: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A remote query as a table.

    split: a numeric column of the query, its lowest and highest value and the number of parts that are read side by side
    (rows outside the values are read too); without it one task reads all.
    """
    if split:
        column, low, high, parts = split
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options).load()
