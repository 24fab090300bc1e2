"""Aggregations: cells, bands, histograms, quantiles, prefixes, documents.

All are partial aggregations by key; whatever spans the whole table is first reduced to a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from . import graph


def hexify(points: DataFrame, cell: str, value: Column) -> DataFrame:
    return points.groupBy(cell).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def raster_hexify(pixels: DataFrame, cell: str, value: str, index: str) -> DataFrame:
    return pixels.groupBy(cell).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"), F.sort_array(F.collect_list(index)).alias("members"))


def roll_up(base: DataFrame, cell: str, res: int, pop: str, elev: str) -> DataFrame:
    """Population and population-weighted elevation by parent (the plain mean where nobody lives)."""
    sums = base.groupBy(cells.parent(F.col(cell), res).alias("parent")).agg(F.sum(pop).alias("pop"), F.sum(F.col(elev) * F.col(pop)).alias("ep"), F.avg(elev).alias("plain"), F.count(F.lit(1)).alias("n"))
    return sums.select("parent", "pop", F.when(F.col("pop") > 0, F.col("ep") / F.col("pop")).otherwise(F.col("plain")).alias("elev"), "n")


def multi_resolution(points: DataFrame, cell: str, resolutions: Sequence[int], value: Column) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("res"), cells.parent(F.col(cell), r).alias("parent")) for r in resolutions)))
    return points.select(each.alias("x"), value.alias("v")).groupBy("x.res", "x.parent").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def weighted_median(df: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key (or of the whole table), the first value whose running weight reaches half of all (equal values count
    together).  Weights are added up by ranges, so that no group is one task's."""
    by = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w")).where("_w > 0")
    reached = (F.col("_before") * 2 < F.col("_all")) & ((F.col("_before") + F.col("_w")) * 2 >= F.col("_all"))
    return below(by, keys, value, "_w").where(reached).select(*keys, F.col(value).alias("weighted_median"))


def distinct_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], error: float | None = None) -> DataFrame:
    """Different values of each column per key: exact, or within a relative standard error by a sketch of fixed size."""
    count = (lambda c: F.count_distinct(c)) if error is None else (lambda c: F.approx_count_distinct(c, error))
    return df.groupBy(*keys).agg(*(count(F.col(c)).alias(c) for c in columns))


def banded(df: DataFrame, value: str, amount: str, edges: Sequence[float | None]) -> DataFrame:
    """Totals by band, lower edge inclusive, None for an open end; empty bands are zero."""
    spark = df.sparkSession
    bands = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("band"))
    v = F.col(value)
    band = F.when(v.isNull(), None)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (F.lit(True) if lo is None else v >= lo) & (F.lit(True) if hi is None else v < hi)
        band = band.when(inside, i)
    sums = df.groupBy(band.alias("band")).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))
    return bands.join(sums, "band", "left").select("band", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int, widen: bool = False) -> DataFrame:
    """Equal-width counts, the last bin closed; widen: a zero range becomes value +- 0.5, else a span of 1."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    if widen:
        same = F.col("lo") == F.col("hi")
        ends = ends.select(F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    ends = F.broadcast(ends.withColumn("span", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("span") * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).crossJoin(ends).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(ends)
    edge = lambda i: F.col("lo") + F.col("span") * i / bins
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def band_stats(df: DataFrame, keys: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """Counts, extremes, moments and percentiles of each group; accuracy: approximate percentiles, off by at most one
    in `accuracy` of the rank, for groups with more different values than a task can hold."""
    at = F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))
    q = F.percentile(value, at) if accuracy is None else F.percentile_approx(value, at, accuracy)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), (F.count(F.lit(1)) - F.count(value)).alias("missing"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), q.alias("q")).select("*", F.col("q")[1].alias("median"), F.col("q")[0].alias("p2"), F.col("q")[2].alias("p98")).drop("q")


#: Sizes of the sketches, and what they promise: the share of the rank by which a quantile is off (99 of 100 times), and
#: three standard errors of a count of different values.
KLL_K, KLL_RANK_ERROR = 400, 0.01
HLL_K, HLL_ERROR = 12, 0.05


def cell_sketches(points: DataFrame, cell: str, value: str, ident: str) -> DataFrame:
    """cell, n, ids (HLL sketch of `ident`), ranks (KLL sketch of `value`): one row of bounded size for each cell, to be
    kept beside the points; all coarser resolutions come from it."""
    return points.groupBy(F.col(cell).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(ident, F.lit(HLL_K)).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("ranks"))


def merged_sketches(sketches: DataFrame, resolutions: Sequence[int]) -> DataFrame:
    """res, parent, n, ids, ranks: the sketches of cells, merged up to each resolution."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("res"), cells.parent(F.col("cell"), r).alias("parent")) for r in resolutions)))
    rows = sketches.select(each.alias("x"), "n", "ids", "ranks")
    return rows.groupBy("x.res", "x.parent").agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("ranks").alias("ranks"))


def sketched_stats(merged: DataFrame, at: Sequence[float] = (0.02, 0.5, 0.98)) -> DataFrame:
    """`merged` with its sketches read: distinct, and q, the quantiles at `at` (null without a value)."""
    quantiles = F.array(*(F.kll_sketch_get_quantile_double("ranks", F.lit(float(t))) for t in at))
    known = F.kll_sketch_get_n_double("ranks") > 0
    return merged.withColumn("distinct", F.hll_sketch_estimate("ids")).withColumn("q", F.when(known, quantiles)).drop("ids", "ranks")


def below(counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """`counts` (one row for each value of each group, n of them) with `_before`, the number of smaller ones, and
    `_all`, the number in the group.

    Values are dealt by range and summed within ranges first, so that a group's size is no task's size.  Without keys
    the whole table is one group.
    """
    if not keys:
        return below(counts.withColumn("_whole", F.lit(1)), ["_whole"], value, n).drop("_whole")
    dealt = graph.cut(counts.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_p").agg(F.sum(n).alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_p", F.coalesce(up_to, F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    inside = F.sum(n).over(Window.partitionBy(*keys, "_p").orderBy(value)) - F.col(n)
    return dealt.withColumn("_inside", inside).join(F.broadcast(sums), [*keys, "_p"]).withColumn("_before", F.col("_inside") + F.col("_offset")).drop("_p", "_inside", "_offset")


def floor_quantile(df: DataFrame, keys: Sequence[str], value: str, t: float) -> DataFrame:
    """The value at index floor(t * n), which is an element of the data (t = 0.5: the upper middle)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    at = F.least(F.floor(F.col("_all") * t), F.col("_all") - 1)
    return below(counts, keys, value, "_c").where((F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))).select(*keys, F.col(value).alias("quantile"))


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def superlative(df: DataFrame, keys: Sequence[str], value: str, seq: str, what: Sequence[str]) -> DataFrame:
    """The row with the largest value per key; of equals the first by `seq`."""
    best = F.max_by(F.struct(*what), F.struct(F.col(value), -F.col(seq)))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def day_histogram(df: DataFrame, ts: str, most: int = 500) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy("day").limit(most)


def per_period(df: DataFrame, period: Column, value: Column, first: int, last: int) -> DataFrame:
    """Sums by whole-number period with missing ones as zero."""
    sums = df.groupBy(period.cast("int").alias("period")).agg(F.sum(value).alias("total"))
    axis = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("period"))
    return axis.join(sums, "period", "left").select("period", F.coalesce("total", F.lit(0)).alias("total"))


def cumulative_curve(df: DataFrame, level: str, levels: Sequence[float]) -> DataFrame:
    """For each level the number of rows at or below it: rows are counted at the first level that holds them."""
    v = F.col(level)
    first = F.when(v.isNull(), None)
    for i, x in enumerate(levels):
        first = first.when(v <= x, i)
    counts = df.groupBy(first.alias("i")).agg(F.count(F.lit(1)).alias("n")).where("i is not null")
    axis = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(levels)], "i int, level double")
    return axis.join(counts, "i", "left").select("level", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("i")).alias("n"))


def mean_of(*columns: str) -> Column:
    """The mean across columns, nulls left out."""
    some = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.try_divide(total, some)


def prefix_roll_up(files: DataFrame, path: str, size: str) -> DataFrame:
    """Every ancestor folder of a listing with the bytes and files below it."""
    parts = F.split(F.col(path), "/")
    rows = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("prefix"), F.col(size).alias("size"))
    return rows.groupBy("prefix").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("files"))


def outermost(entries: DataFrame, path: str) -> DataFrame:
    """Entries that lie in no other entry: an equi-join on exploded proper ancestors."""
    parts = F.split(F.col(path), "/")
    up = entries.select(F.col(path), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_up"))
    inner = up.join(entries.select(F.col(path).alias("_up")), "_up", "left_semi").select(path).distinct()
    return entries.join(inner, path, "left_anti")


def closest_ancestor(entries: DataFrame, path: str) -> DataFrame:
    """path, ancestor: the longest other entry that holds it."""
    parts = F.split(F.col(path), "/")
    up = entries.select(F.col(path), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_up"))
    return up.join(entries.select(F.col(path).alias("_up")).distinct(), "_up").groupBy(path).agg(F.max_by("_up", F.length("_up")).alias("ancestor"))


def document_total(items: str, discount: Column, percent: Column, tax: Column, shipping: Column) -> Column:
    """sum(quantity * price) less a percent or flat discount, plus tax percent, plus shipping."""
    net = F.aggregate(F.col(items), F.lit(0.0), lambda a, x: a + x["quantity"] * x["price"])
    off = F.when(percent, net * discount / 100).otherwise(discount)
    return (net - off) * (1 + tax / 100) + shipping


def next_number(df: DataFrame, client: str, number: str, width: int = 4) -> DataFrame:
    last = F.max(F.regexp_extract(number, r"-(\d+)$", 1).try_cast("int") if hasattr(F.col(number), "try_cast") else F.regexp_extract(number, r"-(\d+)$", 1).cast("int"))
    return df.groupBy(client).agg(F.lpad((F.coalesce(last, F.lit(0)) + 1).cast("string"), width, "0").alias("next"))
