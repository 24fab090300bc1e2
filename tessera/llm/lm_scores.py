"""Language-model scoring with stupid backoff, as count tables, joins and sums.

Words are lower-cased (A-Z) runs of non-space.  All documents are counted: words, and n-grams of each
order up to `order` that occur `min_count` times or more (rarer ones are pruned; 1 prunes none).  Logarithms are
whole millionths of log10, so that sums are exact and don't depend on their order:

    S(w | context) = L(c(context w)) - L(c(context))   if the n-gram is in its table
                   = L(0.4) + S(w | shorter context)   otherwise;   S(w) = L(c(w)) - L(all words)

1. Count tables: lots of documents send their n-grams' hashes, equal ones of a lot summed; they are dealt by hash
   and summed to (key, c).
2. A value table says what each n-gram of a count table adds to a text that holds it.
3. The documents' n-grams, as rows (key, content, times), are joined with the value table on the key and the
   values are summed by document (by `content`, a hash of its words: rows of equal words score alike).

With min_count 1 nothing is pruned, no word of a counted document backs off, and each word's L(c(context))
cancels the word before it up to the order: a text's sum is L of its n-grams of length `order`, less L of those one
shorter that are neither its first nor its last, less L(all words); a text of fewer words has L of itself.  The
rows' `times` carry these signs.  N-grams that occur once have L = 0 and need no row.

At scale: partitions follow the number of words.  N-grams so frequent that at most HOT of them can exist (more
often than one in HOT of all n-grams) are broadcast, added up where the document is, and never shuffled: no
remaining key is hot.  A fixed-size Bloom filter of the value table spares rows that would join nothing, and is left
out when it would be full; the join decides.

Defined cases: a null, empty or word-free text scores 0 with 0 words; texts of equal words score
alike, each row for itself; null ids stay null; other columns are left behind; an empty table gives no
rows.  N-grams are compared by 64-bit hashes: of d different n-grams about d * d / 2**65 pairs share a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import bloom, in_bloom, own_names, parts, small_batches, spread_join, written
from .text import KeyTable, Words, batches, content_of, mix, shingles

FILTER_BITS = 1 << 27
#: N-grams of a shuffle partition, and words that a task sums before it sends them.
PARTITION_GRAMS = 4_000_000
LOT_WORDS = 2_000_000
#: Values that are broadcast at most (12 bytes each).
HOT = 400_000
BACKOFF = -397_940


def millionths(c: Column) -> Column:
    return F.floor(F.log10(c.cast("double")) * 1_000_000 + 0.5).cast("long")


def grams(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the n-grams of each document of a batch."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of = w.doc_of_word()
    at = np.flatnonzero(of[: len(h) - n + 1] == of[n - 1 :])
    return at, h[at] if n == 1 else mix(shingles(h, n)[at] + np.uint64(n))


def gram_rows(docs: DataFrame, n: int, names: bool) -> DataFrame:
    """key, c for each n-gram of each lot; names: context and tail too, its first and last n - 1 words."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            whole = np.concatenate(held, axis=1)
            keys, first, c = np.unique(whole[0], return_index=True, return_counts=True)
            columns = [keys, *whole[1:, first]]
            return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(c)], ["key", "context", "tail", "c"] if names else ["key", "c"])

        for batch in batches(stream, "text"):
            w = Words(batch.column(0), lower=True)
            h = w.hashes()
            at, keys = grams(w, h, n)
            rows = [keys]
            if names:
                shorter = np.zeros(len(h) + 1, np.uint64)
                place, own = grams(w, h, n - 1)
                shorter[place] = own
                rows += [shorter[at], shorter[at + 1]]
            held.append(np.stack(rows))
            if sum(x.shape[1] for x in held) >= LOT_WORDS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "key long, context long, tail long, c long" if names else "key long, c long")


def count_table(docs: DataFrame, n: int, partitions: int, least: int, names: bool = False) -> DataFrame:
    """key, c (and context, tail): the n-grams of all documents that occur `least` times or more."""
    rows = gram_rows(docs, n, names).repartition(partitions, "key")
    extra = [F.first(x).alias(x) for x in ("context", "tail")] if names else []
    return written(rows.groupBy("key").agg(F.sum("c").alias("c"), *extra).where(F.col("c") >= least), f"counts{n}")


def backoff_values(docs: DataFrame, order: int, min_count: int, n_words: int) -> DataFrame:
    """key, c, v: what every n-gram of the pruned count tables adds to a text, beside its words' backed-off scores.

    An n-gram adds its own score less that of its tail and L(0.4).
    """
    partitions = parts(n_words, PARTITION_GRAMS)
    counts = [count_table(docs, n, partitions, min_count if n > 1 else 1, n > 1) for n in range(1, order + 1)]
    scores = counts[0].select("key", "c", (millionths(F.col("c")) - millionths(F.lit(n_words))).alias("s"))
    values = scores.select("key", "c", F.col("s").alias("v"))
    for n in range(2, order + 1):
        own = counts[n - 1].join(counts[n - 2].select(F.col("key").alias("context"), F.col("c").alias("c_context")), "context")
        own = own.join(scores.select(F.col("key").alias("tail"), F.col("s").alias("s_tail")), "tail")
        own = written(own.select("key", "c", (millionths(F.col("c")) - millionths(F.col("c_context"))).alias("s"), "s_tail"), f"scores{n}")
        values = values.unionByName(own.select("key", "c", (F.col("s") - BACKOFF - F.col("s_tail")).alias("v")))
        scores = own.select("key", "c", "s")
    return written(values.where("v <> 0"), "values")


Signs = Callable[[np.ndarray, np.ndarray], np.ndarray]


def text_sums(docs: DataFrame, values: DataFrame, signed: dict[int, Signs | None], n_words: int) -> DataFrame:
    """content, total: the sum of v * times over the texts' n-grams that `values` (key, c, v) has.

    signed: the lengths of n-grams that are looked up, each with a function of (place in the text, words of the
    text) that says how often an occurrence counts (None: once).
    """
    spark = docs.sparkSession
    bound = max(1, -(-n_words * len(signed) // HOT))
    top = values.where(F.col("c") > bound).select("key", "v").toArrow()  # fewer than HOT rows, as their counts add up to all n-grams at most
    keys = top.column("key").to_numpy().view(np.uint64)
    hot = spark.sparkContext.broadcast((KeyTable(keys), top.column("v").to_numpy()[np.argsort(keys)]))
    cold = values.where(F.col("c") <= bound).select("key", "v")
    known = spark.sparkContext.broadcast(bloom(cold, "key", FILTER_BITS))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, worth = hot.value
        for batch in batches(stream, "text"):
            w = Words(batch.column(0), lower=True)
            h = w.hashes()
            content = content_of(w, h)
            here = np.zeros(w.n_docs, np.int64)
            out: list[list[np.ndarray]] = [[], [], []]
            for n, sign in signed.items():
                at, keys = grams(w, h, n)
                doc = np.searchsorted(w.first, at, side="right") - 1
                times = np.ones(len(at), np.int64) if sign is None else sign(at - w.first[doc], w.counts[doc]).astype(np.int64)
                found, i = table.find(keys)
                np.add.at(here, doc[found], worth[i] * times[found])
                rest = in_bloom(known.value, keys) & (times != 0)
                rest[found] = False
                keys, doc, times = keys[rest], doc[rest], times[rest]
                # equal n-grams of a document are one row
                _, first, where = np.unique(mix(keys ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True, return_inverse=True)
                total = np.bincount(where, weights=times, minlength=len(first)).astype(np.int64)
                by = np.argsort(first)
                for column, x in zip(out, (keys[first[by]], doc[first[by]], total[by])):
                    column.append(x)
            keys, doc, times = (np.concatenate(x) for x in out)
            some = np.flatnonzero(here)
            # what is known already travels under a key that spreads it and is in no table
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys.view(np.int64), content[some])), pa.array(content[np.append(doc, some)]), pa.array(np.append(times, np.zeros(len(some), np.int64)).astype(np.int32)), pa.array(np.append(np.zeros(len(doc), np.int64), here[some]))], ["key", "content", "times", "known"])

    partitions = parts(n_words * len(signed), PARTITION_GRAMS)
    rows = docs.select("text").mapInArrow(run, "key long, content long, times int, known long").repartition(partitions, "key")
    joined = rows.join(cold.repartition(partitions, "key").hint("shuffle_hash"), "key", "left")
    return joined.groupBy("content").agg(F.sum(F.coalesce(F.col("v"), F.lit(0)) * F.col("times") + F.col("known")).alias("total"))


def unpruned_sums(docs: DataFrame, rows: DataFrame, order: int, n_words: int) -> DataFrame:
    """content, total: the texts' sums of scores with all n-grams in the tables, but for L(all words)."""
    sums = None
    for n in range(order, 0, -1):
        if n < order - 1 and not rows.where(F.col("n_words") == n).limit(1).count():
            continue  # n-grams below order - 1 only matter where they are a whole text

        def whole(place: np.ndarray, size: np.ndarray, n: int = n) -> np.ndarray:
            return size == n

        def inner(place: np.ndarray, size: np.ndarray, n: int = n) -> np.ndarray:
            return (size == n).astype(np.int64) - ((place > 0) & (place + n < size))

        counts = count_table(docs, n, parts(n_words, PARTITION_GRAMS), 2)
        values = counts.select("key", "c", millionths(F.col("c")).alias("v"))
        own = written(text_sums(docs, values, {n: None if n == order else inner if n == order - 1 else whole}, n_words), f"sums{n}")
        sums = own if sums is None else sums.unionByName(own)
    return sums.groupBy("content").agg(F.sum("total").alias("total"))


def lm_scores(docs: DataFrame, order: int = 3, min_count: int = 1) -> DataFrame:
    """doc_id, n_words, score_micro (sum over words, millionths of log10), score (mean log10)."""
    small_batches(docs.sparkSession)
    docs = own_names(docs, {"doc_id": "long", "text": "string"})

    def name(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w = Words(batch.column(1), lower=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content_of(w, w.hashes())), pa.array(w.counts.astype(np.int64))], ["doc_id", "content", "n_words"])

    rows = written(docs.mapInArrow(name, "doc_id long, content long, n_words long"), "rows")
    n_words = rows.agg(F.sum("n_words")).first()[0] or 0
    if min_count <= 1:
        sums = unpruned_sums(docs, rows, order, n_words)
        whole = int(np.floor(np.log10(max(n_words, 1)) * 1_000_000 + 0.5))
        rest = F.lit(-whole).cast("long") * (F.col("n_words") if order == 1 else F.lit(1))
    else:
        sums = text_sums(docs, backoff_values(docs, order, min_count, n_words), dict.fromkeys(range(1, order + 1)), n_words)
        rest = BACKOFF * sum((F.greatest(F.col("n_words") - n, F.lit(0)) for n in range(1, order)), F.lit(0).cast("long"))
    # rows of equal words were added up: each row's share is the sum over their number
    times = rows.groupBy("content").agg(F.count(F.lit(1)).alias("rows"))
    per = written(sums.join(times, "content").select("content", F.expr("total div rows").alias("total"), "rows"), "totals")
    micro = F.coalesce(F.col("total"), F.lit(0)) + rest
    out = spread_join(rows, per, "content", "rows").select("doc_id", "n_words", F.when(F.col("n_words") > 0, micro).otherwise(0).cast("long").alias("score_micro"))
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("score_micro") / 1e6 / F.col("n_words")).otherwise(F.lit(0.0)))
