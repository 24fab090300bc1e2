"""Shards by extendible hashing.

Rows are hashed (60 bits of an MD5 over all columns); a directory is indexed by hash prefixes.  The
whole table is one bucket; only buckets over the byte limit are split on another bit, until every
bucket fits or holds one row value alone.  Bytes per hash are aggregated once, and each round takes
only the hashes of buckets that are still too large, eight bits further.  Rows then find their bucket
by an equality on the shortest prefix in use plus the bucket's hash range.

A row value that alone exceeds the limit can't be split by bits: its equal rows are counted (in each task
first) and dealt to as many parts as the limit asks for (one row at least per part), which are made in as many
tasks; this changes nothing but how many equal rows lie where.  A single row larger than the limit gets a shard of its own.

Defined cases: null columns count as empty for the hash and the size; repeated rows share a bucket or
its parts; columns `shard_depth`, `shard_prefix` and `shard_part` of the input are replaced, any
other column stays as it is; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import written

BITS = 60
STEP = 8
#: A directory of at most so many buckets (four longs each) is broadcast, a larger one joined.
BROADCAST_BUCKETS = 100_000
SHARD_COLUMNS = ["shard_depth", "shard_prefix", "shard_part"]


def row_hash(docs: DataFrame) -> Column:
    whole = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in docs.columns))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def bits_of(depth: Column, h: Column) -> Column:
    """The first `depth` bits of a hash."""
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, bytes, hashes of the final buckets; `sizes` has (h, bytes, n), one row per h."""
    left, base, out = sizes, 0, None
    while True:
        depths = [d for d in range(base, min(base + STEP, BITS) + 1) if d or not base]
        deepest = depths[-1]
        fine = left.withColumn("p", F.shiftright("h", BITS - deepest)).groupBy("p").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("hashes"))
        level = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("p", deepest - d).alias("prefix")) for d in depths)))
        buckets = written(fine.select(level.alias("b"), "bytes", "hashes").groupBy("b.depth", "b.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("hashes").alias("hashes")), "buckets")
        fits = (F.col("bytes") <= limit) | (F.col("hashes") == 1) | (F.col("depth") == BITS)
        # a bucket exists if its parent was split; the parents of `base` buckets are known to be
        split = buckets.where(~fits).select((F.col("depth") + 1).alias("depth"), "prefix").withColumnRenamed("prefix", "up")
        there = buckets.where(fits).withColumn("up", F.shiftright("prefix", 1))
        new = there.where(F.col("depth") == base).drop("up") if base == 0 else there.limit(0).drop("up")
        new = new.unionByName(there.where(F.col("depth") > base).join(split, ["depth", "up"], "left_semi").drop("up"))
        out = new if out is None else out.unionByName(new)
        over = written(buckets.where((F.col("depth") == deepest) & ~fits).select(F.col("prefix").alias("p")), "over")
        if deepest == BITS or not over.limit(1).count():
            return written(out, "directory")
        left = written(left.withColumn("p", F.shiftright("h", BITS - deepest)).join(over, "p", "left_semi").drop("p"), "left")
        base = deepest


def shard(docs: DataFrame, limit_bytes: int = 16 << 20, text: str = "text") -> DataFrame:
    """`docs` with shard_depth, shard_prefix and shard_part: together the name of a row's shard."""
    docs = docs.drop(*SHARD_COLUMNS)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long")
    sizes = written(docs.select(row_hash(docs).alias("h"), size.alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "sizes")
    found = directory(sizes, limit_bytes)
    least, n = found.agg(F.min("depth"), F.count(F.lit(1))).first()
    least = least or 0
    tree = found.select(F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.expr(f"shiftright(prefix, depth - {least})").alias("_coarse"), F.expr(f"shiftleft(prefix, {BITS} - depth)").alias("_low"), F.expr(f"shiftleft(prefix + 1, {BITS} - depth) - 1").alias("_high"), (F.col("bytes") > limit_bytes).alias("_over"))
    tree = F.broadcast(tree) if n <= BROADCAST_BUCKETS else tree
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), row_hash(docs).alias("_h"), size.alias("_bytes")).withColumn("_coarse", F.shiftright("_h", BITS - least))
    placed = rows.join(tree, (rows["_coarse"] == tree["_coarse"]) & F.col("_h").between(F.col("_low"), F.col("_high"))).select("_row", "_bytes", "_h", "shard_depth", "shard_prefix", "_over")
    out = placed.where(~F.col("_over")).select("_row", "shard_depth", "shard_prefix", F.lit(0).cast("long").alias("shard_part"))
    if found.where(F.col("bytes") > limit_bytes).limit(1).count():
        held = F.greatest(F.floor(F.lit(limit_bytes) / F.greatest("_bytes", F.lit(1))), F.lit(1)).cast("long")
        equal = placed.where("_over").groupBy("_row", "_bytes", "shard_depth", "shard_prefix").agg(F.count(F.lit(1)).alias("n")).withColumn("held", held)
        # first the parts, dealt over all tasks, then the rows of each: as many as a shard holds
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("held")))).alias("shard_part")
        dealt = equal.select("*", part).repartition(F.col("shard_prefix"), F.col("shard_part"))
        copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least("held", F.col("n") - F.col("shard_part") * F.col("held"))))
        out = out.unionByName(dealt.withColumn("_copy", copies).select("_row", "shard_depth", "shard_prefix", "shard_part"))
    return out.select("_row.*", *SHARD_COLUMNS)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard."""
    sharded.repartition(*SHARD_COLUMNS).write.partitionBy(*SHARD_COLUMNS).parquet(path)
