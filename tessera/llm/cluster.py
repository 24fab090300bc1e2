"""What the operators need from the cluster: written tables, fixed-size sketches, checked lookups."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The tables of the innermost `scratch` around the caller; threads have their own.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that `written` makes inside, but for those that stay, when it ends."""
    own: list[str] = []
    before = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(before)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage is cut, lost executors cost nothing.

    The shuffle files of the write go when it ends, as the table takes their place.  The table goes with the `scratch`
    around it, unless it stays.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    own = _scratch.get()
    if own is not None and not stays:
        own.append(path)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "8m") -> SparkSession:
    """Keeps the Arrow batches that go to Python workers small, so that several fit beside a broadcast."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def own_names(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the columns in `wanted`, cast (an id that is no whole number is null); other columns, whatever their
    names, are left behind."""
    return df.select(*(F.col(f"`{c}`").try_cast(t).alias(c) for c, t in wanted.items()))


def carried(df: DataFrame, names: Sequence[str]) -> Column:
    """The named columns as one struct `carried`, which an operator hands on untouched."""
    return F.struct(*(F.col(f"`{c}`") for c in names) if names else [F.lit(0).alias("none")]).alias("carried")


def carried_type(df: DataFrame, names: Sequence[str]) -> str:
    return df.select(carried(df, names)).schema[0].dataType.simpleString()


SLICES = 256
SKETCH_SLICES = 512


def bloom_cells(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Three cell numbers for each 64-bit key, all in the slice that its last byte names (keys that were chosen for
    their smallness differ there as others do)."""
    own = np.uint64(bits // SLICES - 1)
    low, high = (keys >> np.uint64(8)) & np.uint64(0xFFFFFFFF), keys >> np.uint64(40)
    slice_ = (keys & np.uint64(SLICES - 1)) * np.uint64(bits // SLICES)
    for i in range(3):
        yield slice_ + (((low * np.uint64(2 * i + 1) + high * np.uint64(0x9E3779B1 + 2 * i)) >> np.uint64(3)) & own)


def bloom(df: DataFrame, column: str, bits: int) -> np.ndarray | None:
    """A Bloom filter over a long column, `bits` (a power of two) cells packed in bytes; None if it would be full.

    It only spares work: whatever passes it is joined or verified exactly afterwards.  Keys (8 bytes each) are
    dealt to slices by their last byte and each slice is filled in one place, so nothing but the filter itself,
    whose size `bits` fixes, reaches the driver.  Slices with too many keys for their cells let everything pass.
    """
    each = bits // SLICES

    def fill(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in stream:
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            part = (keys & np.uint64(SLICES - 1)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            for some in np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if len(by) else []:
                s = int(part[some[0]])
                seen[s] = seen.get(s, 0) + len(some)
                cells = own.setdefault(s, np.zeros(each, bool))
                if seen[s] <= each // 4:
                    for cell in bloom_cells(keys[some], bits):
                        cells[(cell & np.uint64(each - 1)).astype(np.int64)] = True
        if own:
            full = [seen[s] > each // 4 for s in own]
            yield pa.RecordBatch.from_arrays([pa.array([*own], pa.int32()), pa.array([None if f else np.packbits(x, bitorder="little").tobytes() for f, x in zip(full, own.values())], pa.binary())], ["slice", "cells"])

    tasks = min(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.where(F.col(column).isNotNull()).select(F.col(column).bitwiseAND(SLICES - 1).cast("int").alias("slice"), column)
    rows = dealt.repartition(tasks, "slice").mapInArrow(fill, "slice int, cells binary").collect()
    if sum(cells is None for _, cells in rows) > SLICES // 2:
        return None
    whole = np.zeros(bits // 8, np.uint8)
    for s, cells in rows:
        whole[s * each // 8 : (s + 1) * each // 8] = 255 if cells is None else np.frombuffer(cells, np.uint8)
    return whole


def in_bloom(cells: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    if cells is not None:
        for cell in bloom_cells(keys, len(cells) * 8):
            out &= (cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
    return out


def summed_sketch(df: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], cells: int) -> np.ndarray:
    """How often `count` names each of `cells` (a power of two) cells over all batches, at most 65,535.

    Every task sums its own batches and sends its cells in SKETCH_SLICES compressed slices, which are added up slice by
    slice; only the sums, whose size `cells` fixes, reach the driver.
    """
    each = cells // SKETCH_SLICES

    def local(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.uint32)
        for batch in stream:
            if batch.num_rows:
                np.add(own, np.bincount(count(batch), minlength=cells), out=own, casting="unsafe")
        own = own.reshape(SKETCH_SLICES, each)
        some = np.flatnonzero(own.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([pa.compress(own[i].tobytes(), codec="zstd", asbytes=True) for i in some], pa.binary())], ["slice", "cells"])

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in stream:
            for i, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.setdefault(i, np.zeros(each, np.uint64))
                out[i] += np.frombuffer(pa.decompress(piece, decompressed_size=4 * each, codec="zstd"), np.uint32)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([*out], pa.int32()), pa.array([np.minimum(x, 65_535).astype(np.uint16).tobytes() for x in out.values()], pa.binary())], ["slice", "cells"])

    tasks = min(SKETCH_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.mapInArrow(local, "slice int, cells binary").repartition(tasks, "slice").mapInArrow(add, "slice int, cells binary").collect()
    whole = np.zeros(cells, np.uint16)
    for i, piece in rows:
        whole[i * each : (i + 1) * each] = np.frombuffer(piece, np.uint16)
    return whole


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", broadcast_rows: int = 100_000, salts: int = 32) -> DataFrame:
    """Join `big` with a table that is usually small: broadcast after counting it, else salted.

    `small` is broadcast only if a count shows at most `broadcast_rows` rows.  Otherwise each of
    its rows is repeated for every salt and `big` gets a salt by row, so that a hot key is
    spread over `salts` tasks.  That join is a merge: a plan's estimate, the size of the table's files, knows
    neither of the salts nor of what encodings save, and would have a table broadcast that fills the driver.
    Null keys match nothing.
    """
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return big.join(F.broadcast(small), key, how)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns[:4]]), F.lit(salts)).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(spread.hint("merge"), [key, "_salt"], how).drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, key: str, rows: str, how: str = "left", most: int = 50_000) -> DataFrame:
    """Join `big` with `small`, one row for each key, whose column `rows` says how many rows of `big` have the key.

    Keys with more than one in `most` of all these rows (so fewer than `most` keys) are broadcast, so that no hot
    key lands in one task; the rest is joined by hash.  Both are read twice: give written tables.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    bound = max(1000, total // most)
    hot = F.broadcast(small.where(F.col(rows) > bound).drop(rows))
    rest = big.join(hot.select(key), key, "left_anti").join(small.where(F.col(rows) <= bound).drop(rows), key, how)
    return rest.unionByName(big.join(hot, key))


def parts(rows: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / each))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs: (node, component = its smallest node).

    Alternating star contraction as equi-joins and minima: every round points each node at the
    smallest of its neighbours, and stops when no edge changes.  Edges, never groups, are moved.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(both, "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).first()
    mark_now = mark(now)
    for _ in range(rounds):
        # large star: every larger neighbour of u is linked to the smallest node around u
        sides = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), "edges")
        mark_after = mark(after)
        if mark_after == mark_now:
            return after.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        now, mark_now = after, mark_after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
