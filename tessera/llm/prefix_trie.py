"""A prefix trie of conversations, rolled up by centroid decomposition.

Every conversation is a sequence of turns (role, text); each distinct sequence of first d turns is a node.

1. Turns become digests.  Sorted by conversation, each conversation is read as a stream: the digest of a prefix is the
   digest of the shorter prefix and the next turn's, so no conversation is held in memory.
2. Prefixes of equal digests are one node, with its parent, its members' number and the smallest of them, all by
   partial sums before the shuffle: a first turn that very many conversations share is one row of each task.
3. The forest of parent edges below the root is split.  A node's weight is the number of its members, so the weight
   under a node, the sum of its members' remaining turns, is known from step 2.  As long as a component weighs more
   than `limit`, its centroid (the deepest node with more than half the weight under it) parts it: the subtrees of the
   centroid's children become components, the rest stays one.  The total under the centroid is aggregated and added
   to the nodes from there to the component's top, which are those with more than half the weight.  Which nodes lie
   under the centroid is a join: a node does if its smallest member passes there.  A component's weight halves every
   round, so rounds grow with the logarithm of the rows.
4. Components of at most `limit` nodes are read one by one from sorted partitions, and go on in the same manner there.

Defined cases: a null role or text is empty; a null turn sorts first; equal turn numbers go by the digest of role and
text, and repeated rows are repeated turns; rows without a conv_id belong to no conversation; other columns are left
behind; no conversations give no nodes.  Digests are 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import lookup, small_batches, written

#: Nodes of a component that one task takes whole.
LIMIT = 1_000
ROOT = b""


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), size (UTF-8 bytes of the text)."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    rows = conversations.select(F.col("conv_id").try_cast("long").alias("conv_id"), F.col("turn").try_cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return rows.where("conv_id is not null")


def rebuilt(turns: DataFrame, base_of: Column, prefix_of: Column, longest: int) -> DataFrame:
    """conv, part, turn, digest, size, skip, length: what each conversation is made of, to be read in the order of
    part, turn and digest.

    Part 0 is one row with the conversation's length and how many turns of its own are skipped; part 1 are the first
    turns of another conversation, part 2 all of its own.  `base_of` and `prefix_of` say, from conv_id, which
    conversation begins it and how many of its turns (at most `longest`).
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": base_of, "h": prefix_of})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    firsts = turns.withColumn("i", F.row_number().over(order)).where(F.col("i") <= longest)
    lent = counts.select(F.col("conv_id").alias("conv"), "base", "h").join(firsts.withColumnRenamed("conv_id", "base"), "base").where("i <= h")
    had = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = counts.join(had, "base", "left").select(
        F.col("conv_id").alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"),
        F.col("h").cast("long").alias("skip"), (F.least("h", F.coalesce("n_base", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"),
    )
    nothing = F.lit(None).cast("long")
    parts = [lent.select("conv", F.lit(1).alias("part"), "turn", "digest", "size", nothing.alias("skip"), nothing.alias("length"))]
    parts += [turns.select(F.col("conv_id").alias("conv"), F.lit(2).alias("part"), "turn", "digest", "size", nothing.alias("skip"), nothing.alias("length"))]
    return heads.unionByName(parts[0]).unionByName(parts[1])


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, node, parent, top (the node of the first turn), size, left (turns from here to the end), ends."""
    names = ["conv", "depth", "node", "parent", "top", "size", "left", "ends"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, skip, length, node, top = 0, 0, 0, ROOT, ROOT
        for batch in stream:
            out: list[list] = [[] for _ in names]
            for conv, part, digest, size, own_skip, own_length in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if part == 0:
                    depth, skip, length, node, top = 0, own_skip, own_length, ROOT, ROOT
                    if not length:
                        values = (conv, 0, ROOT, None, ROOT, 0, 1, True)
                        for column, x in zip(out, values):
                            column.append(x)
                    continue
                if part == 2 and skip:
                    skip -= 1
                    continue
                depth += 1
                parent, node = node, hashlib.blake2b(node + digest, digest_size=16).digest()
                top = node if depth == 1 else top
                for column, x in zip(out, (conv, depth, node, parent, top, size, length - depth + 1, depth == length)):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    # asc puts nulls first, in part 0 and among turns
    sorted_rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "turn", "digest").select("conv", "part", "digest", "size", "skip", "length")
    return written(sorted_rows.mapInArrow(run, "conv long, depth long, node binary, parent binary, top binary, size long, left long, ends boolean"), "prefixes")


def nodes_of(chains: DataFrame) -> DataFrame:
    """node, parent, top, depth, size, conv_id (the smallest member), n_convs, weight (the turns at it and below)."""
    first = [F.first(c).alias(c) for c in ("parent", "top", "depth", "size")]
    return chains.where("depth > 0").groupBy("node").agg(*first, F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("left").alias("weight"))


def split(state: DataFrame, chains: DataFrame, limit: int, rounds: int = 100) -> DataFrame:
    """node, parent, depth, comp, leaves, saved, more_leaves, more_saved: the forest in components of at most `limit`
    nodes (comp null: the node is settled), with what each node's total lacks beside its component's."""
    done: list[DataFrame] = []
    for _ in range(rounds):
        # a component's nodes weigh one at least each, so few components are larger than the limit
        large = written(state.where((F.col("node") == F.col("comp")) & (F.col("weight") > limit)).select("comp", F.col("weight").alias("whole")), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done, state)
        inside = lookup(state, large, "comp", "inner")
        centre = inside.where(2 * F.col("weight") > F.col("whole")).groupBy("comp").agg(F.max_by(F.struct("node", "depth", "weight"), "depth").alias("z"))
        inside = lookup(inside, written(centre, "centroids"), "comp", "inner").withColumn("below_depth", F.col("z.depth") + 1)
        steps = chains.where("depth > 0").select(F.col("conv").alias("conv_id"), F.col("depth").alias("below_depth"), F.col("node").alias("child"), F.col("parent").alias("child_of"))
        parted = inside.join(steps, ["conv_id", "below_depth"], "left")
        at, under = F.col("node") == F.col("z.node"), (F.col("depth") >= F.col("below_depth")) & (F.col("child_of") == F.col("z.node"))
        side = F.when(at, "centre").when(under, "below").otherwise("above")
        parted = written(parted.withColumn("side", side), "parted")
        totals = parted.where("side <> 'above'").groupBy("comp").agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
        parted = lookup(parted, written(totals, "totals"), "comp", "inner")
        passed = (F.col("side") == "centre") | ((F.col("side") == "above") & (2 * F.col("weight") > F.col("whole")))
        new = parted.select(
            "node", "parent", "depth", "conv_id", F.when(F.col("side") == "below", F.col("child")).when(F.col("side") == "above", F.col("comp")).alias("comp"),
            F.when(passed, F.col("weight") - F.col("z.weight")).otherwise(F.col("weight")).alias("weight"), *(F.when(F.col("side") == "centre", 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("leaves", "saved")),
            *(F.when(passed, F.col(f"more_{c}") + F.col(f"t_{c}")).otherwise(F.col(f"more_{c}")).alias(f"more_{c}") for c in ("leaves", "saved")),
        )
        new = written(new, "components")
        done += [lookup(state, large.withColumn("large", F.lit(True)), "comp").where("large is null").drop("whole", "large"), new.where("comp is null")]
        state = new.where("comp is not null")
    raise RuntimeError(f"components did not get small in {rounds} rounds")


def decompose(parent: list[int], values: np.ndarray) -> np.ndarray:
    """The sums of `values` under each node of a tree: parent[i] < i for all but the top, which is node 0."""
    total = np.zeros_like(values)
    stack = [list(range(len(parent)))]
    while stack:
        own = stack.pop()
        size = dict.fromkeys(own, 1)
        for v in reversed(own[1:]):
            size[parent[v]] += size[v]
        centre = next(v for v in reversed(own) if 2 * size[v] > len(own))
        above: list[int] = []
        below: dict[int, list[int]] = {}
        under: dict[int, int] = {}  # the centroid's child that a node is under
        for v in own:  # parents come first
            child = -1 if v == own[0] else v if parent[v] == centre else under.get(parent[v], -1)
            if child >= 0:
                under[v] = child
                below.setdefault(child, []).append(v)
            elif v != centre:
                above.append(v)
        sums = values[[centre, *under]].sum(axis=0)
        v = centre
        while v != own[0]:
            total[v] += sums
            v = parent[v]
        total[v] += sums
        stack += [part for part in (above, *below.values()) if part]
    return total


def rolled_up(state: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens: each component's sums, and what `split` has added."""
    names = ["node", "n_leaves", "saved_tokens"]

    def solve(rows: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(rows)
        node, parent = t.column("node").to_pylist(), t.column("parent").to_pylist()
        place = {x: i for i, x in enumerate(node)}
        values = np.stack([t.column(c).to_numpy() for c in ("leaves", "saved")], axis=1)
        total = decompose([place.get(p, 0) for p in parent], values) + np.stack([t.column(f"more_{c}").to_numpy() for c in ("leaves", "saved")], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(total[:, 0]), pa.array(total[:, 1])], names)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in stream:
            comp = batch.column(0).to_pylist()
            edges = [0, *(i for i in range(1, len(comp)) if comp[i] != comp[i - 1]), len(comp)]
            for a, b in zip(edges, edges[1:]):
                if held and comp[a] != last:
                    yield solve(held)
                    held = []
                last = comp[a]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield solve(held)

    here = state.where("comp is not null").select("comp", "node", "parent", "leaves", "saved", "more_leaves", "more_saved", "depth")
    here = here.repartition("comp").sortWithinPartitions("comp", "depth", "node").mapInArrow(run, "node binary, n_leaves long, saved_tokens long")
    return here.unionByName(state.where("comp is null").select("node", (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved_tokens")))


def ends_of(chains: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the conversations that end there, numerically ascending, joined by commas.

    Conversations are dealt by ranges of node and number, so that those of one node may be many tasks'; each task
    joins its own, and the joined pieces of a node are read in order."""

    def pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            node, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            edges = [0, *(i for i in range(1, len(node)) if node[i] != node[i - 1]), len(node)]
            some = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([node[a] for a, _ in some], pa.binary()), pa.array([conv[a] for a, _ in some], pa.int64()), pa.array([",".join(map(str, conv[a:b])) for a, b in some], pa.string())], ["node", "conv", "ids"])

    def digest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, hashlib.sha256()
        for batch in stream:
            names, out = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node == last:
                    h.update(b",")
                else:
                    if last is not None:
                        names.append(last)
                        out.append(h.hexdigest())
                    last, h = node, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], ["node", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["node", "ends_sha256"])

    ends = chains.where("ends").select("node", "conv")
    joined = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node binary, conv long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "conv").select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base_of: Column, prefix_of: Column, longest: int, limit: int = LIMIT) -> DataFrame:
    """node (digest; empty: the root), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, for every node."""
    small_batches(conversations.sparkSession)
    chains = prefixes(rebuilt(written(turns_of(conversations), "turns"), base_of, prefix_of, longest))
    nodes = written(nodes_of(chains), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie")
    zero = F.lit(0).cast("long")
    own = {"leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}
    state = nodes.select("node", "parent", "depth", "conv_id", F.col("top").alias("comp"), "weight", *(c.alias(n) for n, c in own.items()), zero.alias("more_leaves"), zero.alias("more_saved"))
    sums = rolled_up(split(written(state, "components"), chains, limit))
    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    upper = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    smallest, members = chains.where("ends").agg(F.min("conv"), F.count(F.lit(1))).first()
    inner = nodes.join(sums, "node").join(upper, "parent", "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(smallest).cast("long")).otherwise(F.col("parent_conv_id")))
    whole = nodes.agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n_children"), F.sum(own["leaves"]).alias("n_leaves"), F.sum(own["saved"]).alias("saved_tokens"))
    root = whole.where(F.lit(members) > 0).select(
        F.lit(ROOT).alias("node"), F.lit(smallest).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(members).cast("long").alias("n_convs"),
        F.coalesce("n_children", zero).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", zero).cast("long").alias("saved_tokens"),
    )
    out = inner.select(*names).unionByName(root)
    return out.join(ends_of(chains), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
