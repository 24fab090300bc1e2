"""Chunked arrays (Zarr version 3) as rows: one row for each element of a window, by a function and as a data source.

A window touches a block of chunks, which is named by globs, so that only these files are read; chunks are decoded in
tasks (raw, zstd or gzip, little or big endian) and chunks that don't exist hold the fill value.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class ArrayMeta:
    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    separator: str
    codecs: tuple[str, ...]
    fill: float
    dims: tuple[str, ...]
    #: Of a sharded array: the shape of the inner chunks, whether their index ends a shard, and the bytes of its checksum.
    inner: tuple[int, ...] | None = None
    index_last: bool = True
    index_checksum: int = 0


def array_meta(spark: SparkSession, path: str) -> ArrayMeta:
    """What an array's zarr.json says (one small file)."""
    return parsed("\n".join(r[0] for r in spark.read.text(f"{path}/zarr.json", wholetext=True).collect()), path)


def parsed(text: str, path: str) -> ArrayMeta:
    m = json.loads(text)
    sharding = next((c["configuration"] for c in m["codecs"] if c["name"] == "sharding_indexed"), None)
    if sharding:
        m["codecs"] = sharding["codecs"]
    names = [c["name"] for c in m["codecs"]]
    if unknown := set(names) - {"bytes", "zstd", "gzip", "crc32c"}:
        raise ValueError(f"codecs that can't be read: {sorted(unknown)}")
    endian = next((c.get("configuration", {}).get("endian", "little") for c in m["codecs"] if c["name"] == "bytes"), "little")
    dtype = np.dtype(m["data_type"]).newbyteorder("<" if endian == "little" else ">").str
    shape = tuple(m["shape"])
    dims = m.get("dimension_names") or [f"d{i}" for i in range(len(shape))]
    fill = m.get("fill_value", 0)
    separator = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
    return ArrayMeta(path, shape, tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), dtype, separator, tuple(names), float(fill), tuple(d or f"d{i}" for i, d in enumerate(dims)), *(shard_layout(sharding) if sharding else ()))


def shard_layout(sharding: dict) -> tuple[tuple[int, ...], bool, int]:
    index = sharding.get("index_codecs", [])
    return tuple(sharding["chunk_shape"]), sharding.get("index_location", "end") == "end", 4 * any(c["name"] == "crc32c" for c in index)


def decoded(content: bytes, meta: ArrayMeta) -> np.ndarray:
    """An inner chunk (of an array without shards: a chunk)."""
    chunks = meta.inner or meta.chunks
    size = int(np.prod(chunks)) * np.dtype(meta.dtype).itemsize
    for name in reversed(meta.codecs):
        if name == "crc32c":
            content = content[:-4]
        elif name == "zstd":
            content = pa.decompress(content, decompressed_size=size, codec="zstd", asbytes=True)
        elif name == "gzip":
            content = zlib.decompress(content, 47)
    return np.frombuffer(content, meta.dtype).reshape(chunks)


def read_window(spark: SparkSession, path: str, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """The elements low <= index < high of an array: one long column for each dimension and `value` (double)."""
    meta = array_meta(spark, path)
    if meta.inner:
        raise ValueError("shards are read by inner chunks: use `windowed`")
    low = [max(0, a) for a in low]
    high = [min(b, n) for b, n in zip(high, meta.shape)]
    schema = ", ".join(f"`{d}` long" for d in meta.dims) + ", value double"
    if any(a >= b for a, b in zip(low, high)):
        return spark.createDataFrame([], schema)
    spans = [range(a // c, (b - 1) // c + 1) for a, b, c in zip(low, high, meta.chunks)]
    plan = spark.range(1).select(F.array(*(F.lit(0) for _ in ())).cast("array<long>").alias("at"))
    for span in spans:
        plan = plan.withColumn("i", F.explode(F.sequence(F.lit(span[0]).cast("long"), F.lit(span[-1]).cast("long")))).select(F.array_append("at", F.col("i")).alias("at"))
    plan = plan.withColumn("key", F.concat_ws(meta.separator, F.lit("c"), F.transform("at", lambda i: i.cast("string"))))
    block = meta.separator.join("{" + ",".join(map(str, span)) + "}" for span in spans)
    try:
        files = spark.read.format("binaryFile").load(f"{path}/c{meta.separator}{block}").select("path", "content")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], "path string, content binary")
    depth = len(spans) + 1 if meta.separator == "/" else 1
    files = files.select(F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/").alias("key"), "content")

    def rows(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in stream:
            for at, content in zip(batch["at"], batch["content"]):
                own = [(max(a, i * c), min(b, (i + 1) * c), i * c) for a, b, i, c in zip(low, high, at, meta.chunks)]
                part = tuple(slice(a - o, b - o) for a, b, o in own)
                values = np.full(meta.chunks, meta.fill) if content is None else decoded(content, meta)
                values = values[part].astype(np.float64)
                index = np.meshgrid(*(np.arange(a, b) for a, b, _ in own), indexing="ij")
                yield pd.DataFrame({**{d: x.ravel() for d, x in zip(meta.dims, index)}, "value": values.ravel()})

    return plan.join(files, "key", "left").select("at", "content").mapInPandas(rows, schema)


Box = tuple[tuple[int, int], ...]


def element_rows(meta: ArrayMeta, values: np.ndarray | None, box: Box, origin: Sequence[int]) -> pa.RecordBatch:
    """The elements of a box (ranges of indices) of a chunk at `origin`; no chunk holds the fill value."""
    part = tuple(slice(a - o, b - o) for (a, b), o in zip(box, origin))
    own = np.full([b - a for a, b in box], meta.fill) if values is None else values[part].astype(np.float64)
    index = np.meshgrid(*(np.arange(a, b, dtype=np.int64) for a, b in box), indexing="ij")
    return pa.RecordBatch.from_arrays([*(pa.array(x.ravel()) for x in index), pa.array(own.ravel())], [*meta.dims, "value"])


def blocks(box: Box, chunks: Sequence[int]) -> Iterator[tuple[tuple[int, ...], Box]]:
    """The chunks that a box touches, with what it takes of each."""
    spans = [range(a // c, (b - 1) // c + 1) for (a, b), c in zip(box, chunks)]
    for at in itertools.product(*spans):
        yield at, tuple((max(a, i * c), min(b, (i + 1) * c)) for (a, b), i, c in zip(box, at, chunks))


@dataclass
class ChunkPartition(InputPartition):
    """What one task reads: chunks, and the box of each."""

    parts: list[tuple[tuple[int, ...], Box]]


class ChunkedArrayReader(DataSourceReader):
    """Reads a window (low <= index < high for each dimension) of an array: only the (inner) chunks that it touches."""

    def __init__(self, meta: ArrayMeta, window: dict[str, Sequence[int]], tasks: int) -> None:
        if unknown := set(window) - set(meta.dims):
            raise ValueError(f"no such dimensions: {sorted(unknown)}")
        self.meta, self.tasks = meta, tasks
        bounds = [window.get(d, (0, n)) for d, n in zip(meta.dims, meta.shape)]
        self.box = [(max(0, a), min(n, b)) for (a, b), n in zip(bounds, meta.shape)]

    def partitions(self) -> list[ChunkPartition]:
        if any(a >= b for a, b in self.box):
            return [ChunkPartition([])]
        parts = list(blocks(tuple(self.box), self.meta.chunks))
        each = -(-len(parts) // self.tasks)
        return [ChunkPartition(parts[i : i + each]) for i in range(0, len(parts), each)]

    def read(self, partition: ChunkPartition) -> Iterator[pa.RecordBatch]:
        meta = self.meta
        files, root = fs.FileSystem.from_uri(meta.path)
        for at, box in partition.parts:
            key = meta.separator.join(["c", *map(str, at)])
            origin = [i * c for i, c in zip(at, meta.chunks)]
            try:
                file = files.open_input_file(f"{root}/{key}")
            except FileNotFoundError:
                yield element_rows(meta, None, box, origin)
                continue
            with file:
                if meta.inner is None:
                    yield element_rows(meta, decoded(file.read(), meta), box, origin)
                else:
                    yield from self._inner(file, at, box, origin)

    def _inner(self, file: pa.NativeFile, at: Sequence[int], box: Box, origin: Sequence[int]) -> Iterator[pa.RecordBatch]:
        """Of a shard: its index, then only the inner chunks that the box touches."""
        meta = self.meta
        grid = [c // i for c, i in zip(meta.chunks, meta.inner)]
        n = 16 * int(np.prod(grid)) + meta.index_checksum
        index = np.frombuffer(file.read_at(n, file.size() - n if meta.index_last else 0)[: n - meta.index_checksum], "<u8").reshape(*grid, 2)
        local = tuple((a - o, b - o) for (a, b), o in zip(box, origin))
        for inner, part in blocks(local, meta.inner):
            start, size = (int(x) for x in index[inner])
            values = None if start == 2**64 - 1 else decoded(file.read_at(size, start), meta)
            whole = tuple((a + o, b + o) for (a, b), o in zip(part, origin))
            yield element_rows(meta, values, whole, [o + i * c for o, i, c in zip(origin, inner, meta.inner)])


class ChunkedArraySource(DataSource):
    """spark.read.format("chunked_array").load(uri): one long column for each dimension, and `value` (double).

    Folders are read where the tasks run, through the file systems that Arrow knows (file, hdfs, s3, gs); where only
    Spark's readers reach a store, use `read_window`.  Options: `window`, a JSON object of dimensions with [low, high];
    `tasks`, partitions at most.  The window is an option and no pushed filter, as in this version of Spark a filter that
    a Python source has taken stays in force for later queries of the same DataFrame that push none.
    """

    @classmethod
    def name(cls) -> str:
        return "chunked_array"

    def _meta(self) -> ArrayMeta:
        path = self.options["path"].rstrip("/")
        path = path if "://" in path or not path.startswith("/") else f"file://{path}"
        files, root = fs.FileSystem.from_uri(path)
        with files.open_input_stream(f"{root}/zarr.json") as f:
            return parsed(f.read().decode(), path)

    def schema(self) -> str:
        return ", ".join(f"`{d}` long" for d in self._meta().dims) + ", value double"

    def reader(self, schema: StructType) -> ChunkedArrayReader:
        return ChunkedArrayReader(self._meta(), json.loads(self.options.get("window", "{}")), int(self.options.get("tasks", 10_000)))


def windowed(spark: SparkSession, path: str, **window: Sequence[int]) -> DataFrame:
    """The elements of an array within low <= index < high of the named dimensions, through the data source."""
    spark.dataSource.register(ChunkedArraySource)
    return spark.read.format("chunked_array").option("window", json.dumps(window)).load(path)
