"""Substring deduplication with a compressed FM-index per shard.

1. Each document gives content-defined samples (the least of every run of RUN hashes of SAMPLE words).
   A window of `size` words can only repeat if all samples that lie in it do, so only windows whose
   samples two documents or more have go on (a fixed-size Bloom filter tells; it is left out when full).
2. A document visits the shards of its windows' keys, the least sample hash of each: equal windows meet in one
   shard.  Neighbouring windows of one key travel as one region (its word hashes); equal regions of any number of
   documents travel once, with the smallest doc_id that has them.  Keys that very many documents have are told apart
   by their second least sample too, so that a frequent phrase is many keys and not one.
3. A shard takes its documents by rising doc_id, in blocks.  Each block gets a run-length FM-index
   (`fm_index`); its own documents and those of all later blocks are streamed past it, and backward search over
   the wavelet matrix gives their matching statistics: at each word, how long a match with the index starts there.
   Where it reaches `size` words, the range of suffixes gives the smallest doc_id that has the window.
4. A window whose smallest doc_id is below the document's own is reported; overlapping windows
   make one span.

Defined cases: a null or empty text has no words; a null doc_id is smaller than none and removes
nothing elsewhere, nor is anything removed from it; rows that repeat an id and text are judged alike;
texts of fewer than `size` words have no window; other columns are left behind; an empty table gives
no rows.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bloom, in_bloom, own_names, parts, small_batches, spread_join, written
from .fm_index import NO_DOC, FMIndex
from .text import KeyTable, Words, batches, content_of, covered, mix, run_hashes, shingles

SAMPLE, RUN = 8, 10
FILTER_BITS = 1 << 27
REMEMBER = 200_000
#: Words that one shard takes at most, unless a single key has more, and words of one index.
SHARD_WORDS = 1_000_000
INDEX_WORDS = 350_000
#: Keys that are told apart by a second sample at most, and windows of a region.
HOT = 100_000
LEAST_HOT = 2_000
REGION = 256


def first_docs(regions: list[np.ndarray], docs: np.ndarray, size: int) -> list[np.ndarray]:
    """For each window of each region, the smallest doc of the regions that hold it."""
    length = np.array([len(r) for r in regions], np.int64)
    names, ids = np.unique(np.concatenate(regions), return_inverse=True)
    start = np.append(0, np.cumsum(length)[:-1])
    ids, out = ids + 1, np.full(int(length.sum()), NO_DOC, np.int64)
    by = np.argsort(docs, kind="stable")
    block = np.cumsum(length[by]) // INDEX_WORDS
    for b in np.unique(block):
        here = by[block == b]
        own = np.unique(np.concatenate([ids[start[i] : start[i] + length[i]] for i in here]))
        local = np.zeros(len(names) + 1, np.int64)
        local[own] = np.arange(1, len(own) + 1)
        index = FMIndex([local[ids[start[i] : start[i] + length[i]]] for i in here], docs[here], len(own) + 1, size)
        later = by[block >= b]
        _, found = index.match(local[ids], start[later], length[later])
        np.minimum(out, found, out=out)
    return [out[a : a + m - size + 1] for a, m in zip(start, length)]


def samples_of(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of SAMPLE words at each word, sampled place of each run, whether the run is in one document)."""
    grams = shingles(h, SAMPLE)
    if len(grams) < RUN:
        return grams, np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.lib.stride_tricks.sliding_window_view(grams, RUN).argmin(1) + np.arange(len(grams) - RUN + 1)
    doc = w.doc_of_word()
    return grams, at, doc[: len(at)] == doc[SAMPLE + RUN - 2 :][: len(at)]


def repeated_spans(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, content (a hash of the words), spans array<struct<start, end>> of word places that
    windows with a smaller doc_id elsewhere cover; only documents with such a window."""
    if not SAMPLE + RUN - 1 <= size <= 62:
        raise ValueError("size must be between 17 and 62 words")
    spark = small_batches(docs.sparkSession)
    docs = own_names(docs, {"doc_id": "long", "text": "string"})
    runs = size - SAMPLE - RUN + 2

    def sample(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            w = Words(batch.column(0))
            grams, at, whole = samples_of(w, w.hashes())
            at = np.unique(at[whole])
            doc = w.doc_of_word()[at].astype(np.uint64)
            _, first = np.unique(mix(grams[at] ^ (doc * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
            keys, n = np.unique(grams[at[first]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    repeated = written(docs.select("text").mapInArrow(sample, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "samples")
    known = spark.sparkContext.broadcast(bloom(repeated, "key", FILTER_BITS))
    bound = max(LEAST_HOT, -(-(repeated.agg(F.sum("n")).first()[0] or 0) // HOT))
    hot_keys = repeated.where(F.col("n") > bound).select("key").toArrow()  # fewer than HOT rows
    hot = spark.sparkContext.broadcast(KeyTable(hot_keys.column("key").to_numpy().view(np.uint64)))

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches(stream):
            w = Words(batch.column(1))
            h = w.hashes()
            n = len(h) - size + 1
            if n <= 0:
                continue
            grams, at, whole = samples_of(w, h)
            ok = np.zeros(len(grams), bool)
            some = np.unique(at[whole])
            ok[some] = in_bloom(known.value, grams[some])
            bad = np.zeros(len(at) + 1, np.int64)
            np.cumsum(~(ok[at] & whole), out=bad[1:])
            start = np.flatnonzero(bad[runs : runs + n] == bad[:n])
            if not len(start):
                continue
            key = np.empty(len(start), np.uint64)
            for i in range(0, len(start), 20_000):
                inside = grams[start[i : i + 20_000, None] + np.arange(size - SAMPLE + 1)]
                least = inside.min(1)
                often = hot.value.find(least)[0]
                if len(often):
                    rest = inside[often]
                    rest[rest == least[often, None]] = np.iinfo(np.uint64).max
                    least[often] = mix(least[often] ^ mix(rest.min(1)))
                key[i : i + 20_000] = least
            new = np.append(True, (start[1:] != start[:-1] + 1) | (key[1:] != key[:-1]))
            # long regions (of a text that repeats one phrase) are cut; an index finds their windows all the same
            run = np.arange(len(start)) - np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
            edge = np.flatnonzero(run % REGION == 0)
            low, high = start[edge], start[np.append(edge[1:], len(start)) - 1] + size
            region = run_hashes(h, low, high).view(np.int64)
            doc = np.searchsorted(w.first, low, side="right") - 1
            words = []
            for r, a, b in zip(region.tolist(), low.tolist(), high.tolist()):
                if r in sent:
                    words.append(None)
                    continue
                if len(sent) < REMEMBER:
                    sent.add(r)
                words.append(h[a:b].tobytes())
            content = content_of(w, h)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(content[doc]), pa.array((low - w.first[doc]).astype(np.int32)), pa.array(key[edge].view(np.int64)), pa.array(region), pa.array(words, pa.binary())],
                ["doc_id", "content", "start", "key", "region", "words"],
            )

    held = written(docs.mapInArrow(cut, "doc_id long, content long, start int, key long, region long, words binary"), "regions")
    regions = held.groupBy("key", "region").agg(F.min("doc_id").alias("doc_id"), F.max("words").alias("words"), F.count(F.lit(1)).alias("rows"))
    n_words = held.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = regions.repartition(parts(n_words // 8, SHARD_WORDS), "key").sortWithinPartitions("key", "region")

    def index(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, held_words = None, 0

        def flush() -> pa.RecordBatch:
            names, owners, texts, rows = zip(*held)
            found = first_docs([np.frombuffer(x, np.uint64) for x in texts], np.array([NO_DOC if x is None else x for x in owners], np.int64), size)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["region", "rows", "first"])

        for batch in stream:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held_words >= SHARD_WORDS and key != last:
                    yield flush()
                    held, held_words = [], 0
                held.append(tuple(row))
                last, held_words = key, held_words + len(row[2]) // 8
        if held:
            yield flush()

    firsts = written(shards.select("key", "region", "doc_id", "words", "rows").mapInArrow(index, "region long, rows long, first array<long>"), "firsts")

    def spans(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            doc, start = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            rows, low, high = [], [], []
            for i, first in enumerate(batch.column(3)):
                hit = np.flatnonzero(first.values.to_numpy() < doc[i])
                if len(hit):
                    edge = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1))
                    rows += [i] * len(edge)
                    low += (hit[edge] + start[i]).tolist()
                    high += (hit[np.append(edge[1:], len(hit)) - 1] + start[i] + size).tolist()
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["doc_id", "content", "start", "end"])

    own = held.where("doc_id is not null").select("doc_id", "content", "start", "region")
    own = spread_join(own, firsts, "region", "rows", "inner").select("doc_id", "content", "start", "first")
    found = own.mapInArrow(spans, "doc_id long, content long, start int, end int")
    return found.groupBy("doc_id", "content").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def substring_dedup(docs: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), kept (those words
    where any were removed, else null) for every row."""
    spans = written(repeated_spans(docs, size), "spans")
    docs = own_names(docs, {"doc_id": "long", "text": "string"})
    touched = docs.sparkSession.sparkContext.broadcast(bloom(spans.select("content").distinct(), "content", FILTER_BITS >> 3))

    def words_of(w: Words, i: int) -> list[bytes]:
        raw = w.raw
        return [raw[a:b].tobytes() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]

    def joined(w: Words, i: int) -> bytes:
        return b" ".join(w.raw[w.offsets[i] : w.offsets[i + 1]].tobytes().split())

    def settle(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w = Words(batch.column(1))
            content = content_of(w, w.hashes())
            open_ = in_bloom(touched.value, content.view(np.uint64))
            digest = [None if open_[i] else hashlib.sha256(joined(w, i)).hexdigest() for i in range(w.n_docs)]
            text = [x if open_[i] else None for i, x in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content), pa.array(w.counts.astype(np.int64)), pa.array(digest, pa.string()), pa.array(text, pa.string())], ["doc_id", "content", "n_words", "kept_sha256", "text"])

    def remove(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            digest, gone = batch.column(2).to_pylist(), np.zeros(batch.num_rows, np.int64)
            kept: list[str | None] = [None] * batch.num_rows
            w = Words(batch.column(3))
            for i, spans_ in enumerate(batch.column(4).to_pylist()):
                if digest[i] is not None:
                    continue
                out = np.zeros(w.counts[i], bool)
                if spans_:
                    at = np.array([(s["start"], s["end"]) for s in spans_])
                    out = covered(w.counts[i], at[:, 0], at[:, 1] - at[:, 0])
                words = words_of(w, i)
                rest = b" ".join(x for x, o in zip(words, out) if not o)
                gone[i] = out.sum()
                digest[i] = hashlib.sha256(rest).hexdigest()
                kept[i] = rest.decode() if gone[i] else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone), pa.array(digest, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = docs.mapInArrow(settle, "doc_id long, content long, n_words long, kept_sha256 string, text string")
    rows = rows.join(spans, ["doc_id", "content"], "left").select("doc_id", "n_words", "kept_sha256", "text", "spans")
    return rows.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
