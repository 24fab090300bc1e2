"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set is its distinct word shingles (the whole sequence if it has fewer words).  Equal
sets are one node; a node's shingles are ordered by how often the corpus has them (exact counts of the most frequent
ones, a sketch's of the others, ties by hash: one total order for all), rarest first.  Two nodes with
100*|A∩B| >= percent*|A∪B| share a token in their first n - ceil(percent*n/100) + 1 tokens, so
nodes are joined on prefix tokens, cut by the length bound and by the positional bound for the first
token a pair shares, and each pair is
verified once: a suffix filter (the overlap is at most the sum, over ranges of hashes, of the smaller
count of both sets), then the exact overlap.  Only nodes that pass it have their sets read.

A token that m nodes share never makes m*m rows while they are one group already: rounds first
compare every node with one pivot of its token (the node with fewest rarer tokens), linked
nodes become one component, and only pairs that are still in different components are then
enumerated.  Pairs inside a component can't change it, so no component is lost, whatever the
group's size.  Token counts only choose the order; the filters before the joins are fixed-size Bloom
filters whose false positives the joins and the verification remove.

Defined cases: a null, empty or word-free text has n_shingles 0 and links with nothing; a null
doc_id takes part but never names a component (unless all its members are null); repeated rows
are one component; other columns, whatever their names, are left behind; an empty table gives no
rows.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bloom, components, in_bloom, own_names, small_batches, spread_join, summed_sketch, written
from .text import KeyTable, Words, batches, mix, shingles, shingles_one

#: Frequent shingles that are told apart (16 bytes each are broadcast), and how often the least of them occurs.
COMMON = 400_000
LEAST_COMMON = 8
LOT_WORDS = 2_000_000
#: Cells of the sketch of all other shingles (two bytes each).
SKETCH_BITS = 22
PROFILE = 256
FILTER_BITS = 1 << 26
#: Nodes that a task remembers, so that copies it has met send nothing again.
REMEMBER = 200_000


def doc_sets(w: Words, h: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document of a batch."""
    all_of = shingles(h, k)
    for i in range(w.n_docs):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= k:
            yield np.unique(all_of[a : b - k + 1])
        elif b > a:
            yield np.array([shingles_one(h[a:b])])
        else:
            yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


#: The frequent shingles, how often each occurs, and a sketch of how often the others do.
Rarity = tuple[KeyTable, np.ndarray, np.ndarray]


def prefix_of(s: np.ndarray, rarity: Rarity, percent: int) -> np.ndarray:
    """Places in `s` of its prefix tokens, rarest first."""
    n = len(s)
    table, count, sketch = rarity
    often = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
    at, i = table.find(s)
    often[at] = count[i]
    return np.argsort(often, kind="stable")[: n - (percent * n + 99) // 100 + 1]


def rarity_of(docs: DataFrame, k: int) -> Rarity:
    """How often the corpus has each shingle, for an order of all: exact counts of the frequent ones, a sketch's for
    the rest.

    Lots of documents send the shingles they hold twice or more (a shingle that is frequent is so in most lots);
    those with more than one in COMMON of what the lots sent come back, fewer than COMMON.  The sketch tells apart
    the others as long as they are not many times its cells; then they count as alike.
    """
    texts = docs.select("text")

    def shingles_in(batch: pa.RecordBatch) -> np.ndarray:
        w = Words(batch.column(0), lower=True)
        if len(w.starts) < k:
            return np.zeros(0, np.uint64)
        of = w.doc_of_word()
        return shingles(w.hashes(), k)[of[: len(of) - k + 1] == of[k - 1 :]]

    def cells_in(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([(shingles_in(part) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) for part in batches(iter([batch]), "text")])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[c > 1].view(np.int64)), pa.array(c[c > 1])], ["token", "c"])

        for batch in batches(stream, "text"):
            held.append(shingles_in(batch))
            if sum(map(len, held)) >= LOT_WORDS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    counts = written(texts.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")), "tokens")
    bound = max(LEAST_COMMON, -(-(counts.agg(F.sum("c")).first()[0] or 0) // COMMON))
    rows = counts.where(F.col("c") > bound).toArrow()
    keys = rows.column("token").to_numpy().view(np.uint64)
    return KeyTable(keys), rows.column("c").to_numpy()[np.argsort(keys)], summed_sketch(texts, cells_in, 1 << SKETCH_BITS)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that two sets of together n tokens need."""
    return -(-percent * n // (100 + percent))


def profile_of(s: np.ndarray) -> bytes:
    """How many tokens lie in each range of hashes (255: that many or more)."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PROFILE), 255).astype(np.uint8).tobytes()


def suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose profiles allow the overlap they need."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PROFILE) for i in (3, 5))
            # a full cell bounds nothing: the pair is kept if one is full in both
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            keep = pa.array((most >= least_overlap(n_a + n_b, percent)) | ((x == 255) & (y == 255)).any(1))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("profile").alias("p_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("profile").alias("p_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "p_a", "n_b", "p_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                keep[i] = np.count_nonzero(both[1:] == both[:-1]) >= least_overlap(len(both), percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    a = sets.select(F.col("node").alias("a"), F.col("items").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, items: the shingles of the wanted nodes, from one more scan of the texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(nodes, "node", FILTER_BITS))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches(stream, "text"):
            w = Words(batch.column(0), lower=True)
            found, items = [], []
            for s in doc_sets(w, w.hashes(), k):
                if len(s) and (node := node_of(s)) not in seen and in_bloom(wanted.value, np.array([node], np.int64).view(np.uint64))[0]:
                    if len(seen) < REMEMBER:
                        seen.add(node)
                    found.append(node)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(items, pa.binary())], ["node", "items"])

    return written(docs.select("text").mapInArrow(run, "node long, items binary").dropDuplicates(["node"]).join(nodes, "node", "left_semi"), "sets")


def jaccard_nodes(docs: DataFrame, k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) for every row, and (node, component) for every node with a link."""
    spark = small_batches(docs.sparkSession)
    docs = own_names(docs, {"doc_id": "long", "text": "string"})
    counts = spark.sparkContext.broadcast(rarity_of(docs, k))

    def tokens(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches(stream, "text"):
            w = Words(batch.column(0), lower=True)
            out, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in doc_sets(w, w.hashes(), k):
                if len(s) and (node := node_of(s)) not in seen:
                    if len(seen) < REMEMBER:
                        seen.add(node)
                    p = s[prefix_of(s, counts.value, percent)]
                    out.append(p)
                    nodes.append(np.full(len(p), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])

    shared_tokens = docs.select("text").mapInArrow(tokens, "token long, node long").groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    repeated = spark.sparkContext.broadcast(bloom(shared_tokens, "token", FILTER_BITS))

    def postings(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches(stream):
            w = Words(batch.column(1), lower=True)
            nodes, sizes, found, places, profiles = [], [], [], [], []
            for s in doc_sets(w, w.hashes(), k):
                sizes.append(len(s))
                node = node_of(s) if len(s) else None
                nodes.append(node)
                p, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if node is not None and node not in seen:
                    if len(seen) < REMEMBER:
                        seen.add(node)
                    p = s[prefix_of(s, counts.value, percent)]
                    at = np.flatnonzero(in_bloom(repeated.value, p))
                found.append(p[at].view(np.int64))
                places.append(at)
                profiles.append(profile_of(s) if len(at) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(profiles, pa.binary())], ["doc_id", "node", "n", "tokens", "places", "profile"])

    members = written(docs.mapInArrow(postings, "doc_id long, node long, n int, tokens array<long>, places array<int>, profile binary"), "members")
    nodes = members.where(F.col("profile").isNotNull()).select("node", "n", "profile").dropDuplicates(["node"])
    rows = members.where(F.size("tokens") > 0).select("node", "n", F.size("tokens").alias("degree"), F.explode(F.arrays_zip("tokens", "places")).alias("x")).select(F.col("x.tokens").alias("token"), "node", "n", F.col("x.places").alias("place"), "degree")
    rows = rows.groupBy("token", "node").agg(F.first("n").alias("n"), F.first("place").alias("place"), F.max("degree").alias("degree"))
    several = rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    rows = written(rows.join(several, "token", "left_semi"), "postings")

    # the first token that two nodes share has no shared one before it: from it on, both need the overlap
    least = F.expr(f"({percent} * (n + m) + {100 + percent} - 1) div {100 + percent}")
    similar = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("n") - F.col("place") >= least) & (F.col("m") - F.col("spot") >= least)
    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    done = links = group = sets = None
    for turn in range(3):
        now = rows.withColumn("component", F.col("node"))
        if group is not None:
            now = rows.join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn < 2:  # every node with the pivot of its token
            order = F.struct(-F.col("place") / F.col("n") if turn == 0 else F.col("degree") / F.col("n"), F.xxhash64("node"))
            pivots = now.groupBy("token").agg(F.max(F.struct(order.alias("o"), "node", "n", "place", "component")).alias("p"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            pivots = pivots.select("token", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.place").alias("spot"), F.col("p.component").alias("own"))
            pairs = now.join(pivots, "token").where("component <> own").where(similar).select(*pair).distinct()
        else:  # all pairs that are still apart
            apart = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
            left = now.join(apart, "token", "left_semi")
            right = left.select("token", F.col("node").alias("other"), F.col("n").alias("m"), F.col("place").alias("spot"), F.col("component").alias("own"))
            pairs = left.join(right, "token").where("node < other and component <> own").where(similar).select(*pair).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        done = pairs if done is None else done.union(pairs)
        pairs = written(suffix_filter(pairs, nodes, percent), "pairs")
        need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        need = written(need if sets is None else need.join(sets, "node", "left_anti"), "need")
        if need.limit(1).count():
            more = sets_of(docs, need, k)
            sets = more if sets is None else sets.union(more)
        if sets is None:
            continue
        new = written(verified(pairs, sets, percent), "links")
        if not new.limit(1).count():
            continue
        links = new if links is None else links.union(new)
        group = written(components(links), "groups")
    if group is None:
        group = spark.createDataFrame([], "node long, component long")
    return members.select("doc_id", "node", "n"), group


def jaccard_join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) for every row."""
    members, group = jaccard_nodes(docs, k, percent)
    nodes = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    several = nodes.groupBy("component").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    firsts = written(spread_join(nodes, written(several, "several"), "component", "nodes").select("node", F.coalesce("lowest", "least").alias("component_id"), "rows"), "firsts")
    out = spread_join(members.where("n > 0"), firsts, "node", "rows").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.unionByName(members.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """`docs` with one row of each class left: the one with the smallest doc_id, a null being the largest.

    Among rows of one id it is the one of the smallest set (by its name); rows that share id and set are copies, and
    one of them stays.  Different texts under one id are different documents.  Rows without words all stay.
    """
    members, group = jaccard_nodes(docs, k, percent)
    nodes = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "nodes")
    # F.min of the struct: nulls of `least` last, then the smallest id, then the smallest node
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "node")).alias("first")
    several = nodes.groupBy("component").agg(first, F.sum("rows").alias("members"), F.count(F.lit(1)).alias("nodes")).where("members > 1")
    several = written(several.select("component", F.col("first.node").alias("stays"), F.col("first.least").alias("stays_as"), "nodes"), "several")
    classes = written(spread_join(nodes, several, "component", "nodes", "inner").select("node", "stays", "stays_as", "rows"), "classes")
    known = docs.sparkSession.sparkContext.broadcast(bloom(classes, "node", FILTER_BITS))

    def name(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            w = Words(batch.column(1), lower=True)
            nodes = [node_of(s) if len(s) else None for s in doc_sets(w, w.hashes(), k)]
            near = in_bloom(known.value, np.array([x or 0 for x in nodes], np.int64).view(np.uint64)) & np.array([x is not None for x in nodes], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64()), pa.array(near)], ["doc_id", "text", "row", "node", "near"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    rows = rows.mapInArrow(name, f"doc_id long, text string, row {rows.schema['row'].dataType.simpleString()}, node long, near boolean").drop("text")
    placed = spread_join(written(rows.where("near"), "near"), classes, "node", "rows")
    stay = placed.where("stays is null").select("row").unionByName(placed.where("node = stays and doc_id <=> stays_as").dropDuplicates(["node"]).select("row"))
    return rows.where("not near").select("row").unionByName(stay).select("row.*")
