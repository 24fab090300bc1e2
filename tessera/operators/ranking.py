"""Ranks, samples, scores, path windows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import aggregates, graph, joins


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Row numbers of the whole table without one task for all: range partitions (as many as a shuffle has), then
    their offsets."""
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    local = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    local = graph.cut(local)  # range bounds are sampled: both uses below must see the same ones
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return local.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_i") + F.col("_o")).cast("long")).drop("_p", "_i", "_o")


def min_max_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Columns scaled to 0..1 over the table (a zero span gives 0), weighted, and scaled to 0..100 again; a missing
    value takes the upper median of its column."""
    for c in weights:
        median = aggregates.floor_quantile(df.withColumn("_one", F.lit(1)), ["_one"], c, 0.5).select(F.col("quantile").alias("_median"))
        df = df.join(F.broadcast(median), how="left").withColumn(c, F.coalesce(c, "_median")).drop("_median")
    ends = df.agg(*(F.min(c).alias(f"_lo_{c}") for c in weights), *(F.max(c).alias(f"_hi_{c}") for c in weights))
    scaled = lambda c, lo, hi: F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.lit(0.0))
    raw = sum((scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    rows = df.crossJoin(F.broadcast(ends)).select(*df.columns, raw.alias("_raw"))
    ends = rows.agg(F.min("_raw").alias("_a"), F.max("_raw").alias("_b"))
    return rows.crossJoin(F.broadcast(ends)).select(*df.columns, (scaled(F.col("_raw"), F.col("_a"), F.col("_b")) * 100).alias("score"))


def greedy_apart(candidates: DataFrame, score: str, km: float, k: int, max_rounds: int = 200) -> DataFrame:
    """pick, id, lat, lon, score: up to k best candidates (id, lat, lon; ties by id), each more than `km` from all
    better picks.

    A round picks every candidate that is the best within `km` of itself, wherever it is, and drops what these cover;
    with many candidates rounds grow with their logarithm.  Only the best of each tile of half `km` can be one, so few
    are compared with the rest.  Rounds end when none is left that could be among the k best picks.
    """
    rest = graph.cut(candidates.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(score).cast("double").alias(score)))
    value = lambda s, i: F.struct(F.col(s).alias("s"), (-F.col(i)).alias("i"))
    picked: list[DataFrame] = []
    for _ in range(max_rounds):
        row, column = joins.tile_of(F.col("lat"), F.col("lon"), km / 2)
        best = rest.groupBy(row.alias("_r"), column.alias("_c")).agg(F.max(F.struct(value(score, "id").alias("v"), F.struct("id", "lat", "lon", score).alias("x"))).alias("b"))
        best = graph.cut(best.select(F.col("b.x.id").alias("site"), F.col("b.x.lat").alias("site_lat"), F.col("b.x.lon").alias("site_lon"), F.col(f"b.x.{score}").alias("site_score")))
        beaten = joins.radius_pairs(rest, best, km).where(value(score, "id") > value("site_score", "site")).select("site").distinct()
        won = graph.cut(best.join(beaten, "site", "left_anti"))
        picked.append(won.select(F.col("site").alias("id"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"), F.col("site_score").alias(score)))
        rest = graph.cut(rest.join(joins.radius_pairs(rest, won, km).select("id").distinct(), "id", "left_anti"))
        top = rest.agg(F.max(value(score, "id")).alias("v")).first()["v"]
        all_picked = functools.reduce(DataFrame.unionByName, picked)
        if top is None or all_picked.where(value(score, "id") > F.struct(F.lit(top["s"]).cast("double").alias("s"), F.lit(top["i"]).cast("long").alias("i"))).limit(k).count() == k:
            firsts = all_picked.orderBy(F.col(score).desc(), "id").limit(k)
            return firsts.select(F.row_number().over(Window.orderBy(F.col(score).desc(), "id")).alias("pick"), "id", "lat", "lon", score)
    raise RuntimeError(f"not settled after {max_rounds} rounds")


def site_scores(points: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """site, captured, score: points within reach plus half their mean closeness."""
    places = points.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("weight"))
    near = joins.near_sums(sites.select(F.col("site").alias("id"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon")), places, km, distances=True)
    closeness = 1 - F.col("total") / F.col("n") / km
    return near.select(F.col("id").alias("site"), F.col("n").alias("captured"), (F.col("n") + closeness * 0.5).alias("score"))


#: Fixed values of a delivery round, in seconds: a home stop, a stop at a locker, a parcel put into one.
HOME_STOP_S, LOCKER_STOP_S, LOCKER_PARCEL_S = 120, 180, 15


def service_kpis(rounds: DataFrame) -> DataFrame:
    """What lockers save in each round.

    rounds: round, n parcels, n_failed (at the door), redirected (to lockers), failed_captured (of the failed ones),
    lockers used, and km and drive minutes before and after (km_before, drive_before, km_after, drive_after).
    Productivity is parcels in ten minutes.
    """
    c = F.col
    before = c("drive_before") + c("n") * HOME_STOP_S / 60
    after = c("drive_after") + ((c("n") - c("redirected")) * HOME_STOP_S + c("lockers") * LOCKER_STOP_S + c("redirected") * LOCKER_PARCEL_S) / 60
    delivered = c("n") - c("n_failed") + c("failed_captured")
    saved = before - after
    return rounds.select("round", "redirected", c("failed_captured").alias("failed_avoided"), F.round(c("km_before") - c("km_after"), 2).alias("distance_saved_km"), F.round(saved, 1).alias("time_saved_min"), (c("redirected") - c("lockers")).alias("stops_removed"),
        F.round((c("n") - c("n_failed")) / (before / 10), 2).alias("productivity_before"), F.round(delivered / (after / 10), 2).alias("productivity_after"), F.greatest(F.lit(0), F.floor(saved / (before / c("n")))).cast("long").alias("extra_capacity"))


def even_sample(df: DataFrame, index: str, total: int, k: int) -> DataFrame:
    """The rows int(i * n / k) of a table numbered from 0 by `index`."""
    before = F.expr(f"({index} * {k} + {total - 1}) div {total}")
    after = F.expr(f"(({index} + 1) * {k} + {total - 1}) div {total}")
    return df if total <= k else df.where(before < after)


def step_sample(df: DataFrame, index: str, step: int, n: int) -> DataFrame:
    return df.where((F.col(index) % step == 0) & (F.col(index) < step * n))


def hash_sample(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """One in `buckets` rows by an MD5 of the key, the same in every engine."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % buckets == 0)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def thinned(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """Every k-th row of a path and its last."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.where((F.col("_i") % k == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


def rolling_mean(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int) -> DataFrame:
    n = F.datediff(F.col(day), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(n).rangeBetween(-(days - 1), 0)
    return df.withColumn("rolling", F.avg(value).over(w))


def calendar_deviation(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Each value less the mean of its calendar day over all years."""
    w = Window.partitionBy(*keys, F.month(day), F.dayofmonth(day))
    return df.withColumn("normal", F.avg(value).over(w)).withColumn("deviation", F.col(value) - F.col("normal"))


def path_cost(stops: DataFrame, costs: DataFrame, keys: Sequence[str], order: str, stop: str) -> DataFrame:
    """The cost of each round trip: consecutive stops and back to the first, priced by (a, b, cost); null, with the
    number of hops without a price, where any has none."""
    w = Window.partitionBy(*keys).orderBy(order)
    after = F.coalesce(F.lead(stop).over(w), F.first(stop).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    hops = stops.select(*keys, F.col(stop).alias("a"), after.alias("b")).join(costs.select("a", "b", "cost"), ["a", "b"], "left")
    unpriced = F.count(F.lit(1)) - F.count("cost")
    return hops.groupBy(*keys).agg(F.when(unpriced == 0, F.sum("cost")).alias("cost"), F.count(F.lit(1)).alias("hops"), unpriced.alias("unpriced"))


def legs(hops: DataFrame, keys: Sequence[str], order: str, line: str, cost: str) -> DataFrame:
    """keys, leg, line, hops, cost, first: rides on one line as one leg, transfers (a null line) as legs between.

    Of transfers in a row the first counts, and a transfer between two rides on one line is none: the ride goes on.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    was, comes = F.last(line, ignorenulls=True).over(before), F.first(line, ignorenulls=True).over(after)
    again = F.lag(line).over(w).isNull() & (F.row_number().over(w) > 1)
    rows = hops.withColumn("_was", was).withColumn("_comes", comes).withColumn("_again", again)
    rows = rows.where(F.col(line).isNotNull() | (~F.col("_again") & F.coalesce(F.col("_was") != F.col("_comes"), F.lit(True))))
    new = F.when(F.col(line).isNotNull() & F.coalesce(F.col("_was") == F.col(line), F.lit(False)), 0).otherwise(1)
    numbered = rows.withColumn("_new", new).withColumn("leg", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "leg", line).agg(F.count(F.lit(1)).alias("hops"), F.sum(cost).alias("cost"), F.min(order).alias("first"))


def page(df: DataFrame, order: Sequence[Column | str], offset: int, n: int) -> DataFrame:
    """n rows from `offset` on, each with the table's number of rows as `total`."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(n).crossJoin(F.broadcast(total))


FILTERS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
    "is_null": lambda c, v: c.isNull(), "not_null": lambda c, v: c.isNotNull(), "contains": lambda c, v: c.cast("string").contains(str(v)), "starts": lambda c, v: c.cast("string").startswith(str(v)),
}


def filtered(df: DataFrame, filters: Sequence[dict], sorts: Sequence[dict] = ()) -> DataFrame:
    """Filter and sort specs; unknown columns and operators are left out, and no text becomes SQL."""
    for f in filters:
        if f.get("column") in df.columns and f.get("op") in FILTERS:
            df = df.where(FILTERS[f["op"]](F.col(f"`{f['column']}`"), f.get("value")))
    order = [F.col(f"`{s['column']}`").desc() if s.get("dir") == "desc" else F.col(f"`{s['column']}`").asc() for s in sorts if s.get("column") in df.columns]
    return df.orderBy(*order) if order else df
