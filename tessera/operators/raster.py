"""Rasters as pixel tables (raster, row, col, value): centres, pyramids, windows, chunk plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixel_center(west: float, north: float, width: float, height: float, rows: int, cols: int) -> tuple[Column, Column]:
    """(lon, lat) of a pixel's centre; rows run south from the north edge."""
    return west + (F.col("col") + 0.5) * (width / cols), north - (F.col("row") + 0.5) * (height / rows)


def factors(width: int, height: int, smallest: int = 512) -> list[int]:
    """2, 4, 8, .. while the longest side is still `smallest` or more; one level at least."""
    out, f = [], 2
    while max(width, height) / f >= smallest:
        out.append(f)
        f *= 2
    return out or [2]


def pyramid(pixels: DataFrame, levels: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Average-resampled overviews: one row for each level's pixel."""
    each = pixels.where(F.col("value").isNotNull()).withColumn("level", F.explode(F.array(*(F.lit(f) for f in levels))))
    return each.groupBy(*keys, "level", F.floor(F.col("row") / F.col("level")).cast("int").alias("row"), F.floor(F.col("col") / F.col("level")).cast("int").alias("col")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def depth(longest: Column, smallest: int = 512) -> Column:
    """How many overviews `factors` asks for."""
    return F.greatest(F.floor(F.log2(longest / smallest)), F.lit(1)).cast("int")


def missing_pyramids(levels: DataFrame, catalog: DataFrame) -> DataFrame:
    """What overviews would add to rasters that have none: pixels, their percent, and bytes.

    catalog: raster, bytes (of the file), compression.  Resampled pixels take 1.5 times the bytes per pixel under
    lossless codecs, and as many under jpeg, webp or none.
    """
    area = F.col("width") * F.col("height")
    added = levels.groupBy("raster").agg(F.sum(F.when(F.col("k") > 0, area)).alias("added"), F.max(F.when(F.col("k") == 0, area)).alias("whole"))
    codec = F.lower(F.coalesce("compression", F.lit("")))
    penalty = F.when(codec.isin("jpeg", "webp", "none", ""), 1.0).otherwise(1.5)
    rows = added.join(catalog.select("raster", "bytes", penalty.alias("penalty")), "raster")
    return rows.select("raster", "added", F.round(100 * F.col("added") / F.col("whole"), 1).alias("percent"), (F.col("added") * F.col("bytes") / F.col("whole") * F.col("penalty")).cast("long").alias("estimate"))


def level_table(catalog: DataFrame, pixel_bytes: int, block: int) -> DataFrame:
    """Size, pixel size, blocks and share of bytes of every overview level of a raster catalog
    (raster, width, height, res)."""
    levels = catalog.withColumn("k", F.explode(F.sequence(F.lit(0), depth(F.greatest("width", "height")))))
    f = F.pow(F.lit(2.0), F.col("k"))
    w, h = (F.ceil(F.col(c) / f).cast("long") for c in ("width", "height"))
    rows = levels.select("raster", "k", w.alias("width"), h.alias("height"), (F.col("res") * f).alias("res"))
    rows = rows.withColumn("blocks", (F.ceil(F.col("width") / block) * F.ceil(F.col("height") / block)).cast("long")).withColumn("bytes", F.col("width") * F.col("height") * pixel_bytes)
    whole = rows.groupBy("raster").agg(F.sum("bytes").alias("_all"))
    return rows.join(whole, "raster").withColumn("percent", 100 * F.col("bytes") / F.col("_all")).drop("_all")


def level_for(levels: DataFrame, target: Column, slack: float = 1.4) -> DataFrame:
    """raster, k: the coarsest level whose pixel is at most slack * target, else the finest."""
    ok = F.max(F.when(F.col("res") <= target * slack, F.col("k")))
    return levels.groupBy("raster").agg(F.coalesce(ok, F.lit(0)).alias("k"))


def window(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return pixels.where(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1))


def fractional_window(rasters: DataFrame, box: Sequence[str]) -> DataFrame:
    """x0, y0, x1, y1: the pixel window of a box (columns of fractions: left, top, right, bottom) in rasters of
    `width` by `height`; nulls for a window under two pixels and for the whole raster."""
    left, top, right, bottom = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in box)
    ends = {"x0": F.floor(left * F.col("width")), "y0": F.floor(top * F.col("height")), "x1": F.least(F.col("width"), F.rint(right * F.col("width"))), "y1": F.least(F.col("height"), F.rint(bottom * F.col("height")))}
    rows = rasters.withColumns({c: x.cast("long") for c, x in ends.items()})
    whole = (F.col("x0") == 0) & (F.col("y0") == 0) & (F.col("x1") == F.col("width")) & (F.col("y1") == F.col("height"))
    ok = (F.col("x1") - F.col("x0") >= 2) & (F.col("y1") - F.col("y0") >= 2) & ~whole
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in ends})


def window_bounds(windows: DataFrame, transform: Sequence[float]) -> DataFrame:
    """left, bottom, right, top of pixel windows under an affine transform (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    xs = [c + a * F.col(x) + b * F.col(y) for x, y in (("x0", "y0"), ("x1", "y1"))]
    ys = [f + d * F.col(x) + e * F.col(y) for x, y in (("x0", "y0"), ("x1", "y1"))]
    return windows.withColumns({"left": F.least(*xs), "bottom": F.least(*ys), "right": F.greatest(*xs), "top": F.greatest(*ys)})


def composite(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """row, col, r, g, b: bands 1, 2 and 3, each stretched between its percentiles."""
    rows = stretched(pixels.where(F.col("band").isin(1, 2, 3)), low, high)
    return rows.groupBy("row", "col").agg(*(F.max(F.when(F.col("band") == i, F.col("value"))).alias(c) for i, c in enumerate("rgb", 1)))


def mosaic(tiles: DataFrame, size: int = 256) -> DataFrame:
    """Tile pixels (tile_x, tile_y, row, col, value) on the global pixel grid."""
    return tiles.select((F.col("tile_y") * size + F.col("row")).alias("row"), (F.col("tile_x") * size + F.col("col")).alias("col"), "value")


def warp(source: DataFrame, target: DataFrame, to_row: Column, to_col: Column) -> DataFrame:
    """Nearest-neighbour warp: `target` (trow, tcol and whatever the formulas need) takes the source pixel
    that the inverse mapping names."""
    at = target.withColumn("row", F.floor(to_row).cast("int")).withColumn("col", F.floor(to_col).cast("int"))
    return at.join(source.select("row", "col", "value"), ["row", "col"], "left").select("trow", "tcol", "value")


def stretched(pixels: DataFrame, low: float = 0.02, high: float = 0.98, keys: Sequence[str] = ("band",)) -> DataFrame:
    """Percentile stretch to 0..255 per band."""
    ends = pixels.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q"))
    scaled = (F.col("value") - F.col("q")[0]) / F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1e-12)) * 255
    return pixels.join(ends, list(keys)).withColumn("value", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(scaled))).cast("int")).drop("q")


def decimated(pixels: DataFrame, step: int) -> DataFrame:
    return pixels.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def chunk_plan(windows: DataFrame, chunks: Sequence[int]) -> DataFrame:
    """The chunk keys that windows (id, lo array, hi array; hi exclusive) touch, one row each."""
    out = windows
    for i, size in enumerate(chunks):
        out = out.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(F.col("lo")[i] / size), F.floor((F.col("hi")[i] - 1) / size))))
    names = [f"_c{i}" for i in range(len(chunks))]
    return out.select("id", F.array(*names).alias("chunk"), F.concat_ws("/", F.lit("c"), *names).alias("key"))


def point_chunk(points: DataFrame, shape: Sequence[str], chunks: Sequence[int]) -> DataFrame:
    """The chunk that owns each point and the place inside it."""
    at = [F.floor(F.col(c) / n) for c, n in zip(shape, chunks)]
    return points.withColumn("key", F.concat_ws("/", F.lit("c"), *at)).withColumn("offset", sum((F.col(c) % n * _below(chunks, i) for i, (c, n) in enumerate(zip(shape, chunks))), F.lit(0)).cast("long"))


def _below(chunks: Sequence[int], i: int) -> int:
    out = 1
    for n in chunks[i + 1 :]:
        out *= n
    return out


#: Words in the names of auxiliary arrays, which are nobody's first choice.
AUXILIARY = ("mask", "quality", "condition", "angle", "footprint", "classification", "probability")


def inventory(arrays: DataFrame) -> DataFrame:
    """grid (chunks along each axis), their number and the bytes of arrays (store, name, shape, chunks, itemsize, dtype),
    and `preferred`: its store's default variable.

    That is, of arrays with two axes or more that aren't bounds: no auxiliary one, with the largest last two axes,
    of floats, with most axes, by name.
    """
    grid = F.zip_with("shape", "chunks", lambda s, c: F.greatest(F.ceil(s / c), F.lit(1)))
    product = lambda x: F.aggregate(x, F.lit(1).cast("long"), lambda a, y: a * y)
    name = F.lower("name")
    data = (F.size("shape") >= 2) & ~F.coalesce(name.endswith("bnds") | name.endswith("_bounds"), F.lit(False))
    aux = name.rlike("|".join(AUXILIARY))
    rows = arrays.withColumn("_data", data).withColumn("_last", F.when(F.size("shape") >= 2, product(F.slice("shape", F.greatest(F.size("shape") - 1, F.lit(1)), F.lit(2)))))
    order = [F.desc("_data"), aux, F.desc("_last"), F.desc(F.col("dtype").startswith("float")), F.desc(F.size("shape")), "name"]
    first = F.row_number().over(Window.partitionBy("store").orderBy(*order)) == 1
    return rows.select("store", "name", grid.alias("grid"), product(grid).alias("n_chunks"), (product("shape") * F.col("itemsize")).alias("bytes"), (first & F.col("_data")).alias("preferred"))


def read_ledger(log: DataFrame) -> DataFrame:
    """Requests, bytes fetched and cache hits by key."""
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(~F.col("hit"), F.col("bytes")).otherwise(0)).alias("fetched"), F.sum(F.col("hit").cast("int")).alias("hits"))
