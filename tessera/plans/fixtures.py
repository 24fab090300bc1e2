"""Geometry derived from the given tables by whole-number formulas that every SQL engine evaluates alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cell(k: str, power: str) -> str:
    digits = " | ".join(f"((({k} {power} {7 ** (8 - r)}) % 7) * {2 ** (3 * (15 - r))})" for r in range(1, 9))
    return f"({2**59 + (8 << 52) + (20 << 45) + 2097151} | {digits})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, elev, cents, nation, cell (resolution 8) for each customer."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS id",
        "cast((c_custkey * 7919) % 36000 AS double) / 100 - 180 AS lon",
        "cast((c_custkey * 104729) % 17000 AS double) / 100 - 85 AS lat",
        "cast((c_custkey * c_custkey * 31 + c_custkey * 17) % 4000 AS double) / 10 - 50 AS elev",
        "cast(round(c_acctbal * 100) AS bigint) AS cents",
        "c_nationkey AS nation",
        f"{_cell('c_custkey', 'div')} AS cell",
    )


PTS = f"""pts AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 36000)::DOUBLE / 100 - 180 AS lon,
  ((c_custkey * 104729) % 17000)::DOUBLE / 100 - 85 AS lat,
  ((c_custkey * c_custkey * 31 + c_custkey * 17) % 4000)::DOUBLE / 10 - 50 AS elev,
  cast(round(c_acctbal * 100) AS bigint) AS cents, c_nationkey AS nation,
  {_cell('c_custkey', '//')} AS cell FROM customer)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, site_lat, site_lon for each supplier."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "s_suppkey AS site",
        "cast((s_suppkey * 104729 + 500) % 17000 AS double) / 100 - 85 AS site_lat",
        "cast((s_suppkey * 7919 + 1300) % 36000 AS double) / 100 - 180 AS site_lon",
    )


SITES = """sites AS (SELECT s_suppkey AS site, ((s_suppkey * 104729 + 500) % 17000)::DOUBLE / 100 - 85 AS site_lat,
  ((s_suppkey * 7919 + 1300) % 36000)::DOUBLE / 100 - 180 AS site_lon FROM supplier)"""

KM = "(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(site_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(site_lat)) * pow(sin(radians(site_lon - lon) / 2), 2)))))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, value: one pixel per order."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_orderkey div 128 AS int) AS row", "cast(o_orderkey % 128 AS int) AS col", "cast((o_orderkey * o_orderkey * 31 + o_custkey * 7) % 4000 AS int) AS value")


PIXELS = "pixels AS (SELECT (o_orderkey // 128)::INT AS row, (o_orderkey % 128)::INT AS col, ((o_orderkey * o_orderkey * 31 + o_custkey * 7) % 4000)::INT AS value FROM orders)"


def parent_sql(cell: str, res: int) -> str:
    mask = (1 << 3 * (15 - res)) - 1
    return f"((({cell} | {mask}) & {~(15 << 52)}) | {res << 52})"
