"""Quality rules: per-text measures and cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits folded to 0, white space collapsed) and hashed.  For
each host the documents that hold a line are counted over the whole corpus.  A line is above the limit if more
than `min_docs` documents of the host hold it, and either more than `max_share` percent of the host's documents or
more than `max_docs` of them: on a large host the absolute limit decides.  Such lines are removed, and a
document that keeps less than `min_left` percent of its words is rejected as depleted, as are documents that fail
the base rules.

Tasks sum equal lines of a host over many documents before they send counts, so neither a hot line nor a hot
host gathers in one task.  The lines above the limit are broadcast (8 bytes each) after a count shows at most
BROADCAST_LINES of them; otherwise the lines of documents that may be above it (a fixed-size Bloom filter tells) are
joined with the table, and the found lines with their documents.

Defined cases: null and empty texts have no words, lines or symbols and fail the base rules; a null
host is a host of its own; every row is one document, copies and repeated rows included; null ids stay null;
other columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bloom, carried, carried_type, in_bloom, lookup, small_batches, written
from .text import KeyTable, Words, batches, byte_hashes, content_of, mix, run_hashes, shingles

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Lines above the limit that are broadcast at most, and lines that a task sums before it sends them.
BROADCAST_LINES = 1_000_000
LOT_LINES = 500_000
FILTER_BITS = 1 << 27

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[0x30:0x3A] = 0x30
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Lines:
    """The \\n-split lines of a batch that hold a word: document, normalised hash, words, places."""

    def __init__(self, w: Words) -> None:
        n = len(w.raw)
        cut = w.raw == 0x0A
        begins = np.zeros(n + 1, bool)
        begins[w.offsets] = True
        begins[1:] |= cut
        first_word = np.unique(np.searchsorted(w.starts, np.flatnonzero(begins)))
        self.low = first_word[first_word < len(w.starts)]
        self.high = np.append(self.low[1:], len(w.starts))
        self.doc = np.searchsorted(w.first, self.low, side="right") - 1
        self.words = self.high - self.low
        self.hash = run_hashes(byte_hashes(_FOLD[w.raw], w.starts, w.ends), self.low, self.high)

    def raw_hash(self, w: Words) -> np.ndarray:
        """Hashes of the lines as they stand, between their \\n."""
        n = len(w.raw)
        edge = np.zeros(n + 1, bool)
        edge[w.offsets] = True
        breaks = np.flatnonzero(edge | np.append(w.raw == 0x0A, True))
        at = w.starts[self.low]
        i = np.searchsorted(breaks, at, side="right")
        begin = breaks[i - 1] + (w.raw[np.minimum(breaks[i - 1], n - 1)] == 0x0A)
        end = breaks[i]
        return byte_hashes(w.raw, begin, end)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        twin = s[1:] == s[:-1]
        same[1:] |= twin
        same[:-1] |= twin
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def measures(w: Words, lines: Lines) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    n = len(w.raw)
    lead = (w.raw & 0xC0) != 0x80
    total = np.zeros(n + 1, np.int64)
    np.cumsum(lead, out=total[1:])
    chars = np.zeros(len(w.starts) + 1, np.int64)
    np.cumsum(total[w.ends] - total[w.starts], out=chars[1:])
    doc = w.doc_of_word()
    runs = shingles(w.hashes(), 3)
    whole = doc[: len(runs)] == doc[2:] if len(runs) else np.zeros(0, bool)
    hot = np.zeros(len(doc), bool)
    if len(runs):
        at = np.flatnonzero(whole)
        twice = at[repeated(mix(runs[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))]
        for j in range(3):
            hot[twice + j] = True
    key = mix(lines.raw_hash(w) ^ (lines.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    held = np.bincount(lines.doc, minlength=w.n_docs)
    _, first = np.unique(key, return_index=True)
    unlike = np.bincount(lines.doc[first], minlength=w.n_docs)
    return {"n_words": w.counts.astype(np.int64), "word_chars": chars[w.first[1:]] - chars[w.first[:-1]], "n_symbols": per_doc(_IS_SYMBOL[w.raw], w.offsets), "n_dup_lines": (held - unlike).astype(np.int64), "n_repeat_words": per_doc(hot, w.first)}


def _inputs(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("source").cast("string")).alias("host"), carried(docs, carry))


def line_keys(w: Words, lines: Lines, host: np.ndarray) -> np.ndarray:
    """A hash of each line and its host."""
    return mix(lines.hash ^ mix(host[lines.doc].view(np.uint64)))


def frequent_lines(docs: DataFrame, min_docs: int, max_share: int, max_docs: int) -> DataFrame:
    """key (of line and host): the lines above the limit."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, host = (np.concatenate(x) for x in zip(*held))
            key, first, n = np.unique(key, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(host[first]), pa.array(n)], ["key", "host", "n"])

        for batch in batches(stream, "text"):
            w, host = Words(batch.column(0)), batch.column(1).to_numpy()
            lines = Lines(w)
            key = line_keys(w, lines, host)
            _, once = np.unique(mix(key ^ (lines.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
            # every document also holds its host's own key: that count is the host's number of documents
            held.append((np.append(key[once], host.view(np.uint64)), np.append(host[lines.doc[once]], host)))
            if sum(len(x) for x, _ in held) >= LOT_LINES:
                yield flush()
                held.clear()
        if held:
            yield flush()

    counts = _inputs(docs).select("text", "host").mapInArrow(run, "key long, host long, n long").groupBy("key", "host").agg(F.sum("n").alias("n"))
    counts = written(counts.where((F.col("key") == F.col("host")) | (F.col("n") > min_docs)), "lines")
    hosts = counts.where("key = host").select("host", F.col("n").alias("docs"))
    held = lookup(counts.where("key <> host"), hosts, "host", "inner")
    return written(held.where((F.col("n") * 100 > F.col("docs") * max_share) | (F.col("n") > max_docs)).select("key"), "above")


def banned_lines(docs: DataFrame, above: DataFrame) -> DataFrame:
    """content (of text and host), banned array<long>: the keys above the limit in each text that has any."""
    known = docs.sparkSession.sparkContext.broadcast(bloom(above, "key", FILTER_BITS))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text"):
            w, host = Words(batch.column(0)), batch.column(1).to_numpy()
            lines = Lines(w)
            key = line_keys(w, lines, host)
            some = np.flatnonzero(in_bloom(known.value, key))
            yield pa.RecordBatch.from_arrays([pa.array(content_of(w, w.hashes())[lines.doc[some]] ^ host[lines.doc[some]]), pa.array(key[some].view(np.int64))], ["content", "key"])

    rows = _inputs(docs).select("text", "host").mapInArrow(run, "content long, key long").distinct()
    return written(rows.join(above, "key", "left_semi").groupBy("content").agg(F.collect_set("key").alias("banned")), "banned")


def quality_rules(docs: DataFrame, min_docs: int = 4, max_share: int = 10, max_docs: int = 10_000, min_left: int = 30, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (without the removed lines), the measures, n_removed_words, base_failed, kept, and
    the columns named in `carry` as the struct `carried`."""
    spark = small_batches(docs.sparkSession)
    above = frequent_lines(docs, min_docs, max_share, max_docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    small = above.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    table = spark.sparkContext.broadcast(KeyTable(above.toArrow().column("key").to_numpy().view(np.uint64)) if small else None)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w, host = Words(batch.column(1)), batch.column(2).to_numpy()
            lines = Lines(w)
            m = measures(w, lines)
            key = line_keys(w, lines, host)
            out = np.zeros(len(key), bool)
            edges = np.searchsorted(lines.doc, np.arange(w.n_docs + 1))
            if table.value is not None:
                out[table.value.find(key)[0]] = True
            else:
                for d, banned in enumerate(batch.column(4)):
                    if banned.values is not None:
                        out[edges[d] : edges[d + 1]] = np.isin(key[edges[d] : edges[d + 1]], banned.values.to_numpy().view(np.uint64))
            removed = np.bincount(lines.doc[out], weights=lines.words[out], minlength=w.n_docs).astype(np.int64)
            text = batch.column(1)
            if out.any():
                plain = text.to_pylist()
                for d in np.unique(lines.doc[out]):
                    plain[d] = without(plain[d], out[edges[d] : edges[d + 1]])
                text = pa.array(plain, pa.string())
            n = m["n_words"]
            failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            kept = ~failed & (100 * (n - removed) >= min_left * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *(pa.array(m[x]) for x in names), pa.array(removed), pa.array(failed), pa.array(kept), batch.column(3)], ["doc_id", "text", *names, "n_removed_words", "base_failed", "kept", "carried"])

    def name(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w = Words(batch.column(1))
            content = content_of(w, w.hashes()) ^ batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content)], [*batch.schema.names, "content"])

    rows = _inputs(docs, carry)
    if not small:
        kind = carried_type(docs, carry)
        rows = lookup(rows.mapInArrow(name, f"doc_id long, text string, host long, carried {kind}, content long"), banned_lines(docs, above), "content", broadcast_rows=0).select("doc_id", "text", "host", "carried", "banned")
    return rows.mapInArrow(run, "doc_id long, text string, " + ", ".join(f"{x} long" for x in names) + f", n_removed_words long, base_failed boolean, kept boolean, carried {carried_type(docs, carry)}")


def without(text: str, out: np.ndarray) -> str:
    """`text` without the lines (of those that hold a word, in order) that `out` marks."""
    kept, i = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            i += 1
            if out[i - 1]:
                continue
        kept.append(line)
    return "\n".join(kept)
