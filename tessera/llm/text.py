"""Vectorised word scanning over Arrow text columns (numpy, used inside tasks).

A batch of documents is one contiguous UTF-8 buffer.  Words are found and hashed with array
operations over that buffer, so the cost per byte is a few nanoseconds and no Python object is
made per word.  Hashes are 64-bit: bytes go through a mixer eight at a time, one step after the other; a run of
hashes is a sum whose terms are multiplied by a random factor of their place and folded first, so that no
arrangement of equal pieces cancels.  Two different runs agree with odds of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(0x5EED)
_STEP = U64(0x9E3779B97F4A7C15)
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Bytes of text that one numpy batch holds, unless one document is larger.
BATCH_BYTES = 1 << 18

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_factors = np.zeros(0, np.uint64)


def factors(n: int) -> np.ndarray:
    """A random factor for each of n places, kept between batches."""
    global _factors
    if len(_factors) >= n:
        return _factors[:n]
    out = mix((np.arange(max(n, 4096), dtype=np.uint64) + U64(1)) * _STEP)
    if n <= 4 * BATCH_BYTES:
        _factors = out
    return out[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run values[start:end] of 64-bit values, which may overlap or be empty."""
    sizes = ends - starts
    edges = np.append(0, np.cumsum(sizes))
    place = np.arange(edges[-1])
    place -= np.repeat(edges[:-1], sizes)
    terms = factors(int(sizes.max(initial=0)))[place]
    if edges[-1] == len(values) and np.array_equal(starts, edges[:-1]):
        terms *= values
    else:
        place += np.repeat(starts, sizes)
        terms *= values[place]
    terms ^= terms >> U64(32)
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    return mix(total[edges[1:]] - total[edges[:-1]] + sizes.astype(np.uint64) * _STEP)


_PIECE = 256
_FIRST = np.array([2 ** (8 * i) - 1 for i in range(9)], np.uint64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each run of bytes data[start:end]: eight bytes a step, long runs as runs of pieces."""
    sizes = ends - starts
    if sizes.max(initial=0) > _PIECE:
        n = np.maximum(-(-sizes // _PIECE), 1)
        edges = np.append(0, np.cumsum(n))
        run = np.repeat(np.arange(len(n)), n)
        low = starts[run] + (np.arange(edges[-1]) - edges[run]) * _PIECE
        h = byte_hashes(data, low, np.minimum(low + _PIECE, ends[run]))
        out = h[edges[:-1]]
        out[n > 1] = run_hashes(h, edges[:-1][n > 1], edges[1:][n > 1])
        return out
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)
    h = mix(sizes.astype(np.uint64) * _STEP)
    some, at = np.arange(len(sizes)), starts
    for step in range(0, max(int(sizes.max(initial=0)), 1), 8):
        if step:
            some = some[sizes[some] > step]
            at = starts[some] + step
        chunk = eight[at].view(np.uint64)[:, 0] & _FIRST[np.minimum(sizes[some] - step, 8)]
        h[some] = mix(h[some] ^ chunk)
    return h


def spans_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a batch: starts and ends in `data`, and first[i]:first[i+1] for document i."""

    def __init__(self, column: pa.Array, lower: bool = False, alnum: bool = False) -> None:
        raw, self.offsets = spans_of(column)
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        table = _ALNUM if alnum else _SPACE
        n = len(raw)
        self.n_docs = len(self.offsets) - 1
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        own = inside[1:-1]
        self.starts = np.flatnonzero(own & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(own & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs, dtype=np.int32), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        return byte_hashes(self.data, self.starts, self.ends)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words that start at each word (documents not told apart)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _MULT[0]
    for j in range(1, k):
        out += h[j : j + n] * _MULT[j]
    return mix(out)


def shingles_one(h: np.ndarray) -> np.uint64:
    """The hash of one whole sequence of words, as `shingles` gives it for a long enough k."""
    return mix(np.array([(h * _MULT[: len(h)]).sum(dtype=np.uint64)]))[0]


def content_of(w: Words, h: np.ndarray) -> np.ndarray:
    """A hash of each document's words, in order."""
    return run_hashes(h, w.first[:-1], w.first[1:]).view(np.int64)


def batches(stream: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most BATCH_BYTES of text each (one row at least)."""
    for batch in stream:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, off = spans_of(column)
        row, n = 0, batch.num_rows
        while row < n:
            end = int(np.searchsorted(off, off[row] + BATCH_BYTES, side="right")) - 1
            end = min(max(end, row + 1), n)
            yield batch.slice(row, end - row)
            row = end
        pa.default_memory_pool().release_unused()


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """A mask of n positions that runs of `length` from `starts` cover."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + length, -1)
    return np.cumsum(delta[:-1]) > 0


class KeyTable:
    """A table of 64-bit keys that answers fast for most keys outside it."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> U64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, index in keys) of the hashes of h that are in the table."""
        at = np.flatnonzero(self.maybe[(h >> U64(42)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[i] == h[at]
        return at[same], i[same]
