"""The data source of chunked arrays: windows, shards read by inner chunks."""

import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import arrays

SHAPE, SHARD, INNER = (10, 7, 9), (4, 4, 6), (2, 4, 3)
WHOLE = np.arange(10 * 7 * 9, dtype=np.int16).reshape(SHAPE)


def write_array(folder, last, checksum, codec="zstd"):
    """A sharded array; inner chunks of zeros are left out, and one shard wholly."""
    meta = {"shape": SHAPE, "data_type": "int16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": SHARD}}, "fill_value": -5, "dimension_names": ["t", "y", "x"]}
    inner = [{"name": "bytes", "configuration": {"endian": "big"}}] + ([{"name": codec}] if codec else [])
    index = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": "crc32c"}] if checksum else [])
    meta["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": INNER, "codecs": inner, "index_codecs": index, "index_location": "end" if last else "start"}}]
    want = WHOLE.astype(float)
    padded = np.zeros((12, 8, 12), ">i2")
    padded[:10, :7, :9] = WHOLE
    grid = [c // i for c, i in zip(SHARD, INNER)]
    for at in np.ndindex(3, 2, 2):
        low = [i * c for i, c in zip(at, SHARD)]
        if at == (1, 0, 1):
            want[tuple(slice(a, a + c) for a, c in zip(low, SHARD))] = -5
            continue
        n = 16 * int(np.prod(grid)) + 4 * checksum
        body, table, place = b"", [], 0 if last else n
        for q in np.ndindex(*grid):
            first = [a + i * c for a, i, c in zip(low, q, INNER)]
            box = tuple(slice(a, a + c) for a, c in zip(first, INNER))
            if sum(q) == 1 and at == (0, 0, 0):
                table.append((2**64 - 1, 2**64 - 1))
                want[box] = -5
                continue
            part = padded[box].tobytes()
            part = pa.compress(part, codec="zstd", asbytes=True) if codec == "zstd" else part
            table.append((place + len(body), len(part)))
            body += part
        tail = np.array(table, "<u8").tobytes() + (zlib.crc32(b"").to_bytes(4, "little") if checksum else b"")
        path = folder.joinpath("c", *map(str, at))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body + tail if last else tail + body)
    (folder / "zarr.json").write_text(json.dumps(meta))
    return want


@pytest.mark.parametrize("last,checksum,codec", [(True, True, "zstd"), (False, False, None), (True, False, "zstd")])
def test_windows_of_shards(spark, tmp_path, last, checksum, codec):
    want = write_array(tmp_path / "a", last, checksum, codec)
    df = arrays.windowed(spark, str(tmp_path / "a"))
    assert {(r["t"], r["y"], r["x"]): r["value"] for r in df.collect()} == {at: v for at, v in np.ndenumerate(want)}
    part = arrays.windowed(spark, str(tmp_path / "a"), t=(2, 7), y=(3, 4), x=(-5, 8))
    some = part.where("x > 1 and value > 100").collect()
    assert {(r["t"], r["y"], r["x"]) for r in some} == {at for at, v in np.ndenumerate(want) if 2 <= at[0] < 7 and at[1] == 3 and 1 < at[2] < 8 and v > 100}
    assert part.count() == 5 * 8 and arrays.windowed(spark, str(tmp_path / "a"), t=(50, 60)).count() == 0
    assert df.groupBy("t").agg(F.sum("value").alias("s")).where("t = 9").first()["s"] == want[9].sum()


def test_only_touched_inner_chunks_are_read(tmp_path, monkeypatch):
    write_array(tmp_path / "a", True, True, None)
    reader = arrays.ChunkedArraySource({"path": str(tmp_path / "a"), "window": '{"t": [4, 6], "x": [0, 1], "y": [0, 3]}'}).reader(None)
    seen = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            seen.append(n)
            return self.file.read_at(n, at)

    class Files:
        def __init__(self, files):
            self.files = files

        def open_input_file(self, path):
            return Counting(self.files.open_input_file(path))

    files, root = arrays.fs.FileSystem.from_uri(reader.meta.path)
    monkeypatch.setattr(arrays.fs, "FileSystem", type("X", (), {"from_uri": staticmethod(lambda uri: (Files(files), root))}))
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    # one shard: its index of four inner chunks, and one inner chunk of 24 numbers
    assert rows == 2 * 3 * 1 and seen == [4 * 16 + 4, 48]


def test_plain_arrays_and_many_chunks_in_few_tasks(spark, tmp_path):
    folder = tmp_path / "b"
    (folder / "c").mkdir(parents=True)
    values = np.arange(20, dtype="<f4")
    for i in range(10):
        (folder / "c" / str(i)).write_bytes(values[2 * i : 2 * i + 2].tobytes())
    (folder / "zarr.json").write_text(json.dumps({"shape": [20], "data_type": "float32", "chunk_grid": {"configuration": {"chunk_shape": [2]}}, "fill_value": 0, "codecs": [{"name": "bytes"}]}))
    spark.dataSource.register(arrays.ChunkedArraySource)
    df = spark.read.format("chunked_array").option("tasks", 3).load(f"file://{folder}")
    assert [tuple(r) for r in df.orderBy("d0").collect()] == [(i, float(i)) for i in range(20)] and df.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="inner"):
        write_array(tmp_path / "c", True, True)
        arrays.read_window(spark, f"file://{tmp_path}/c", (0, 0, 0), (1, 1, 1))
