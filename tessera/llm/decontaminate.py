"""Benchmark decontamination as a prefix-filtered containment join.

A benchmark item's windows (its runs of `size` words, or the whole item if shorter) are sets of
5-word shingles in fixed places.  A window is contained only if all its shingles are, so one prefix token decides:
the shingle that the corpus holds least often.

1. The benchmark's windows and shingles are tables; equal windows of any number of items are one row.
2. The corpus counts of these shingles come from one scan; windows with a shingle that no document has go.  Each
   other window keeps its rarest shingle and its place.
3. A second scan sends the documents' occurrences of these prefix tokens with the words around them, once for
   equal texts; they are joined with the windows on the token.  The place bounds where the window must start and
   end (length and positional bounds), and the words are compared one by one.
4. Found windows are gathered by text and attached to the documents in a third scan.

Only shingles that a fixed-size Bloom filter of the benchmark's lets pass leave the scans.  Windows are broadcast for
the join only after a count (at most 100,000 rows of `size` words), else joined with salted tokens; what was found
likewise, by its number of spans and items, and then only texts that may have any are shuffled.

Defined cases: a null or empty text has no words, no hits and is clean; an item without words is
never found; items with equal windows are all reported; the windows of an item without an id hit like any other but
name no item; repeated document rows are each reported; an empty benchmark finds nothing; other columns are
left behind, clashing names included.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bloom, carried, carried_type, in_bloom, lookup, own_names, small_batches, written
from .text import Words, batches, content_of, covered, shingles, shingles_one

SHINGLE = 5
FILTER_BITS = 1 << 26
LOT_TOKENS = 1_000_000
#: Texts that a task remembers, so that copies it has met send nothing again.
REMEMBER = 200_000
#: Spans and items that are broadcast at most (some 50 bytes each).
BROADCAST_FOUND = 500_000


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item, window (a hash of its words), words array<long>: the distinct windows of each item."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w = Words(batch.column(1), lower=True, alnum=True)
            h = w.hashes()
            items, names, rows = [], [], []
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = h[w.first[i] : w.first[i + 1]]
                k = min(size, len(own))
                for j in range(len(own) - k + 1 if k else 0):
                    items.append(item)
                    rows.append(own[j : j + k].view(np.int64))
                    names.append(shingles_one(own[j : j + k]) + np.uint64(k))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(rows, pa.list_(pa.int64()))], ["item", "window", "words"])

    return written(own_names(benchmark, {"item_id": "string", "text": "string"}).mapInArrow(run, "item string, window long, words array<long>").dropDuplicates(["item", "window"]), "windows")


def window_tokens(windows: DataFrame) -> DataFrame:
    """window, token, place: the shingles of each window (of q words: SHINGLE, or all of a shorter window)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            names, tokens, places = [], [], []
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words.values.to_numpy().view(np.uint64)
                t = shingles(own, min(SHINGLE, len(own)))
                names += [name] * len(t)
                tokens.append(t)
                places += range(len(t))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)), pa.array(places, pa.int32())], ["window", "token", "place"])

    return windows.select("window", "words").dropDuplicates(["window"]).mapInArrow(run, "window long, token long, place int")


def tokens_in(w: Words, h: np.ndarray, q: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(place, token) of the shingles of q words, each in one document, that pass the filter."""
    t = shingles(h, q)
    if not len(t):
        return np.zeros(0, np.int64), t
    of = w.doc_of_word()
    at = np.flatnonzero(in_bloom(known, t) & (of[: len(t)] == of[q - 1 :]))
    return at, t[at]


def corpus_counts(texts: DataFrame, tokens: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """token, n: how often the corpus has the tokens that pass the benchmark's filter."""
    known = texts.sparkSession.sparkContext.broadcast(bloom(tokens, "token", FILTER_BITS))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])

        for batch in batches(stream, "text"):
            w = Words(batch.column(0), lower=True, alnum=True)
            h = w.hashes()
            held += [tokens_in(w, h, q, known.value)[1] for q in lengths]
            if sum(map(len, held)) >= LOT_TOKENS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return written(texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")


def occurrences(texts: DataFrame, prefixes: DataFrame, lengths: Sequence[int], size: int) -> DataFrame:
    """content (of a text), start, k, window: every verified occurrence, once for equal texts."""
    known = texts.sparkSession.sparkContext.broadcast(bloom(prefixes, "token", FILTER_BITS))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches(stream, "text"):
            w = Words(batch.column(0), lower=True, alnum=True)
            h = w.hashes()
            content = content_of(w, h)
            new = np.array([c not in seen for c in content.tolist()], bool)
            met: list[np.ndarray] = []
            for q in lengths:
                at, token = tokens_in(w, h, q, known.value)
                doc = np.searchsorted(w.first, at, side="right") - 1
                at, token, doc = at[new[doc]], token[new[doc]], doc[new[doc]]
                low = np.maximum(at - size + 1, w.first[doc])
                high = np.minimum(at + size, w.first[doc + 1])
                met.append(doc)
                around = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(high - low)).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(h[a:b].view(np.int64) for a, b in zip(low, high))])))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(content[doc]), pa.array((at - w.first[doc]).astype(np.int32)), pa.array((at - low).astype(np.int32)), around], ["token", "content", "at", "before", "around"])
            if len(seen) < REMEMBER and met:
                seen.update(content[np.unique(np.concatenate(met))].tolist())

    rows = texts.mapInArrow(run, "token long, content long, at int, before int, around array<long>").dropDuplicates(["token", "content", "at"])
    near = lookup(rows, prefixes, "token", "inner")
    fits = (F.col("place") <= F.col("before")) & (F.col("before") - F.col("place") + F.col("k") <= F.size("around"))
    same = F.slice("around", F.col("before") - F.col("place") + 1, F.col("k")) == F.col("words")
    return near.where(fits).where(same).select("content", (F.col("at") - F.col("place")).alias("start"), "k", "window")


def found_windows(texts: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """content, spans array<struct<start, size>> (in words), items array<string>: the texts with occurrences."""
    windows = item_windows(benchmark, size)
    tokens = written(window_tokens(windows), "tokens")
    distinct = tokens.select("token").distinct()
    lengths = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect())  # SHINGLE values at most
    counts = corpus_counts(texts, distinct, lengths)
    rarest = lookup(tokens, counts, "token").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("p")).where("p.n > 0")
    once = windows.select("window", "words").dropDuplicates(["window"])
    prefixes = written(rarest.join(once, "window").select("p.token", "p.place", F.size("words").alias("k"), "words", "window"), "prefixes")
    hits = written(occurrences(texts, prefixes, lengths, size), "hits")
    spans = hits.groupBy("content").agg(F.sort_array(F.collect_set(F.struct("start", F.col("k").alias("size")))).alias("spans"))
    named = lookup(hits.select("content", "window").distinct(), windows.where("item is not null").select("window", "item"), "window", "inner")
    items = named.groupBy("content").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return written(spans.join(items, "content", "left").select("content", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, percent: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, n_words, n_hit, items (sorted as strings), spans, contaminated, carried, for every row.

    A word is hit inside any occurrence of a window; contaminated: n_hit > 0 and the hits are at
    least `percent` of the words.
    """
    spark = small_batches(docs.sparkSession)
    found = found_windows(own_names(docs, {"text": "string"}), benchmark, size)
    known = spark.sparkContext.broadcast(bloom(found, "content", FILTER_BITS))

    def name(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w = Words(batch.column(1), lower=True, alnum=True)
            content = content_of(w, w.hashes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w.counts.astype(np.int64)), pa.array(content), pa.array(in_bloom(known.value, content.view(np.uint64)))], [*batch.schema.names, "n_words", "content", "touched"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n_words = batch.column(3).to_numpy()
            hit = np.zeros(len(n_words), np.int64)
            for d, spans in enumerate(batch.column(4)):
                if len(spans):
                    at, sizes = (spans.values.field(i).to_numpy() for i in (0, 1))
                    hit[d] = covered(n_words[d], at, sizes).sum()
            bad = (hit > 0) & (100 * hit >= percent * n_words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(hit), batch.column(5), batch.column(4), pa.array(bad), batch.column(2)], ["doc_id", "text", "n_words", "n_hit", "items", "spans", "contaminated", "carried"])

    kind = carried_type(docs, carry)
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), carried(docs, carry)).mapInArrow(name, f"doc_id long, text string, carried {kind}, n_words long, content long, touched boolean")
    if (found.agg(F.sum(F.size("spans") + F.size("items"))).first()[0] or 0) <= BROADCAST_FOUND:
        rows = rows.join(F.broadcast(found), "content", "left")
    else:
        nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("spans", "items")]
        rows = rows.where("not touched").select("*", *nothing).unionByName(lookup(rows.where("touched"), found, "content", broadcast_rows=0))
    empty = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items")]
    return rows.select("doc_id", "text", "carried", "n_words", *empty).mapInArrow(run, f"doc_id long, text string, n_words long, n_hit long, items array<string>, spans array<struct<start: int, size: int>>, contaminated boolean, carried {kind}")
