"""Conversation structure repair by an auction algorithm for shortest paths.

A conversation's repair is a path through a lattice of (rows read, state): states are what the kept roles form, and
arcs are the edits, with small whole costs.  K keeps a row, R gives it the other role, D deletes it, I inserts an empty
turn.  Auction iterations (path extension and contraction) raise node prices until the path from the start reaches the
end; prices never exceed an arc's cost plus the next price, so arcs where they are equal (tight) on a way to the
end are exactly those of shortest paths, and the repair is traced over them, least letter first.

1. `faults`: each row's first fault.  Texts become digests; equal rows of a conversation are found by sums before the
   shuffle, so that a row that is repeated very often is no task's burden.
2. Rows without their texts are dealt by ranges of (conversation, turn) and cut into blocks of at most BLOCK rows, so a
   long conversation is many tasks'.  A block is a word over nine letters (role and fault), and equal words are
   solved once in a task.
3. Only for conversations of several blocks: auctions give each block's costs between states; a fold from the last
   block to the first (numbers of blocks, not of rows) gives the price of each state behind each block.
4. With these prices each block is solved and traced from each state it may be entered in; the traces are chained.
5. The digest of the repaired turns is a stream over the conversation's rows in order, with its edits in front: no
   conversation is held in memory.

Defined cases: a null role or text is one space; a null turn sorts first; equal turn numbers go by the digest of role
and text; a repeated row is a duplicate; rows without a conv_id form a conversation of their own; other columns are
left behind; no conversations give no rows; a conversation without rows gives zeros and an empty repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import small_batches, written

#: Rows of a block.
BLOCK = 128
#: Fixed values of the contract: states of `(s?(ua)+)?` with the state that each role leads to, and the costs.
START, SYSTEM, USER, REPLY = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): REPLY, (REPLY, "u"): USER}
GIVEN = {START: "u", SYSTEM: "u", USER: "a", REPLY: "u"}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 40

Arc = tuple[str, int, int]


def arcs_of(word: str, exits: tuple[int, ...], last: bool) -> list[list[Arc]]:
    """The arcs (letter, cost, next node) of node 4 * rows read + state, by letter; the end is the last node.

    A letter of `word` is a row: s, u, a or x (another role); the same in upper case if truncated; `-` must be deleted.
    exits: the price of leaving behind the last row in each state (FAR: never).  Turns are inserted before a row, and
    behind the last one only at the conversation's end.
    """
    n = len(word)
    arcs: list[list[Arc]] = [[] for _ in range(4 * n + 5)]
    for i in range(n + 1):
        for q in range(4):
            own = arcs[4 * i + q]
            if i == n and exits[q] < FAR:
                own.append(("", exits[q], 4 * n + 4))
            if i < n:
                row, extra = word[i].lower(), TRUNCATED if word[i].isupper() else 0
                own.append(("D", DELETE, 4 * i + 4 + q))
            if i < n or last:
                own.append(("I", INSERT, 4 * i + NEXT[q, GIVEN[q]]))
            if i < n and row != "-":
                if (q, row) in NEXT:
                    own.append(("K", KEEP + extra, 4 * i + 4 + NEXT[q, row]))
                own.append(("R", REROLE + extra, 4 * i + 4 + NEXT[q, GIVEN[q]]))
    return arcs


def start_prices(word: str, exits: tuple[int, ...]) -> list[int]:
    """Prices that no arc contradicts: a row with a fault costs 2 at least, and leaving costs the cheapest exit."""
    prices = [min(exits)] * 4
    for letter in reversed(word):
        prices = [prices[0] + (DELETE if letter == "-" or letter.isupper() else 0)] * 4 + prices
    return [*prices, 0]


def auction(arcs: list[list[Arc]], prices: list[int], start: int) -> None:
    """Extends and contracts a path from `start` until it reaches the end; prices[start] is then its cost (FAR: there
    is none).  Prices may come from an earlier auction to the same end."""
    end, path = len(arcs) - 1, [start]
    while path[-1] != end:
        here = path[-1]
        best, to = FAR, -1
        for _, cost, node in arcs[here]:
            if cost + prices[node] < best:
                best, to = cost + prices[node], node
        if prices[here] < best or to < 0:  # contract
            prices[here] = best
            if len(path) > 1:
                path.pop()
            elif to < 0:
                return
        else:
            path.append(to)


def reach(arcs: list[list[Arc]], prices: list[int]) -> list[bool]:
    """The nodes that tight arcs lead from to the end."""
    into: list[list[int]] = [[] for _ in arcs]
    for node, own in enumerate(arcs):
        for _, cost, to in own:
            if prices[node] == cost + prices[to]:
                into[to].append(node)
    out = [False] * len(arcs)
    todo = [len(arcs) - 1]
    while todo:
        node = todo.pop()
        if not out[node]:
            out[node] = True
            todo += into[node]
    return out


@lru_cache(maxsize=20_000)
def traces(word: str, exits: tuple[int, ...], last: bool, entries: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """For each entry state: the cost, the least letters among the cheapest, and the state behind the block."""
    arcs, prices = arcs_of(word, exits, last), start_prices(word, exits)
    for q in entries:
        auction(arcs, prices, q)
    good = reach(arcs, prices)
    out = []
    for q in entries:
        letters, node = [], q
        while True:
            letter, _, to = min(arc for arc in arcs[node] if prices[node] == arc[1] + prices[arc[2]] and good[arc[2]])
            if to == len(arcs) - 1:
                break
            letters.append(letter)
            node = to
        out.append((prices[q], "".join(letters), node % 4))
    return out


@lru_cache(maxsize=20_000)
def passage(word: str) -> list[int]:
    """The costs from each state before a block to each behind it, row by row (FAR: no way)."""
    out = [FAR] * 16
    for to in range(4):
        exits = tuple(0 if q == to else FAR for q in range(4))
        # a start is never come back to, and a system turn only follows it
        entries = {START: (START,), SYSTEM: (START, SYSTEM)}.get(to, (START, SYSTEM, USER, REPLY))
        arcs = arcs_of(word, exits, False)
        if to in (START, SYSTEM):
            arcs = [[x for x in own if x[2] == len(arcs) - 1 or x[2] % 4 <= to] for own in arcs]
        if to == SYSTEM:
            arcs = [own if node % 4 <= to else [] for node, own in enumerate(arcs)]
        prices = start_prices(word, exits)
        for q in entries:
            auction(arcs, prices, q)
            out[4 * q + to] = min(prices[q], FAR)
    return out


#: The prices of ending in each state, and with turns inserted behind the last row.
ENDS, CLOSING = (0, FAR, FAR, 0), (0, 2 * INSERT, INSERT, 0)


def key_of() -> list[Column]:
    return [F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv")]


def damaged(conversations: DataFrame) -> DataFrame:
    """known, conv (the conversation), turn, copy, gone, role, text: the rows after the damage that their number's
    CRC-32 names; dropped rows stay, marked as gone."""
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").try_cast("long").alias("conv_id"), F.col("turn").try_cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`").cast("string"), space).alias(c) for c in ("role", "text")))
    damage = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))) % 20
    rows = rows.select(*key_of(), "turn", "role", "text", damage.alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("known", "conv", "turn", F.explode(copies).alias("copy"), (F.col("damage") == 0).alias("gone"), role.alias("role"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """known, conv, turn, digest, copy, gone, initial, fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    ending = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = written(rows.select("known", "conv", "turn", digest.alias("digest"), "copy", "gone", F.substring("role", 1, 1).alias("initial"), ending.alias("ending")), "rows")
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "copy")
    # rows that are equal in all have one place: how many there are tells the first from the rest
    places = light.where("not gone").groupBy("known", "conv", "digest", at.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    firsts = places.groupBy("known", "conv", "digest").agg(F.min("place").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    marked = light.join(firsts, ["known", "conv", "digest"], "left").withColumn("later", F.coalesce(at != F.col("first"), F.lit(False)))
    fault = F.when(F.col("ending") == "", 1).when(F.col("later"), 2).when(~F.col("ending").isin(".", "!", "?"), 3).otherwise(0)
    return marked.select("known", "conv", "turn", "digest", "copy", "gone", "initial", fault.alias("fault"))


BLOCK_FIELDS = "known boolean, conv long, part int, seq long, word string, blank long, duplicate long, truncated long, illegal long, initials string, first long, last long, turns long, passage array<long>"


def blocks(light: DataFrame, size: int) -> DataFrame:
    """Runs of at most `size` rows of a conversation, by rising (part, seq)."""
    names = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, key, state, before = 0, None, None, None
        out: list[list] = []

        def close() -> None:
            nonlocal seq
            out.append([*key, 0, seq, "".join(state["word"]), *state["n"], state["illegal"], state["initials"], state["first"], state["last"], state["turns"], []])
            seq += 1

        for batch in stream:
            for known, conv, turn, digest, gone, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or (known, conv) != key or len(state["word"]) >= size:
                    if state is not None:
                        close()
                    key, state = (known, conv), {"word": [], "n": [0, 0, 0], "illegal": 0, "initials": "", "first": None, "last": None, "turns": 0}
                if gone:
                    continue
                # equal rows of one place are told apart here
                if fault in (0, 3) and before == (key, turn, digest):
                    fault = 2
                before = (key, turn, digest)
                if fault:
                    state["n"][fault - 1] += 1
                letter = initial if initial in ("s", "u", "a") else "x"
                state["word"].append("-" if fault in (1, 2) else letter.upper() if fault == 3 else letter)
                if state["initials"] and state["initials"][1] + letter not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["initials"] = (state["initials"] or letter)[0] + letter
                if turn is not None:
                    state["first"] = turn if state["first"] is None else state["first"]
                    state["turns"] += turn != state["last"]
                    state["last"] = turn
            if out:
                yield rows_of(out)
                out = []
        if state is not None:
            close()
            yield rows_of(out)

    def rows_of(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    place = ["known", "conv", "turn", "digest", "copy"]
    dealt = light.repartitionByRange(*place).sortWithinPartitions(*place).select("known", "conv", "turn", "digest", "gone", "initial", "fault")
    return dealt.mapInArrow(cut, BLOCK_FIELDS).withColumn("part", F.spark_partition_id())


def passages(many: DataFrame) -> DataFrame:
    """`many` with the costs from each state before a block to each behind it."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = batch.schema.get_field_index("passage")
            costs = pa.array([passage(w) for w in batch.column("word").to_pylist()], pa.list_(pa.int64()))
            yield batch.set_column(at, "passage", costs)

    return many.mapInArrow(run, many.schema)


def plans(cut: DataFrame) -> DataFrame:
    """known, conv, part, seq, word, exits array<long>, first, last for every block, and the conversation's counts."""

    def fold(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for costs in batch.column("costs").to_pylist():
                exits, behind = list(CLOSING), [list(ENDS)]
                for way in reversed(costs[1:]):
                    exits = [min(FAR, *(way[4 * q + to] + exits[to] for to in range(4))) for q in range(4)]
                    behind.append(exits)
                out.append(behind[::-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("known", "conv", "where")), pa.array(out, pa.list_(pa.list_(pa.int64())))], ["known", "conv", "where", "exits"])

    key = ["known", "conv"]
    several = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    many = passages(cut.join(several, key, "left_semi"))
    # for each block of a long conversation: sixteen costs
    gathered = many.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("part", "seq", "passage"))).alias("b")).select(*key, F.col("b.passage").alias("costs"), F.transform("b", lambda x: F.struct(x["part"].alias("part"), x["seq"].alias("seq"))).alias("where"))
    folded = gathered.mapInArrow(fold, "known boolean, conv long, where array<struct<part: int, seq: long>>, exits array<array<long>>")
    spread = folded.select(*key, F.size("where").alias("n"), F.posexplode(F.arrays_zip("where", "exits")).alias("i", "x"))
    ends = spread.select(*key, F.col("x.where.part").alias("part"), F.col("x.where.seq").alias("seq"), F.col("x.exits").alias("exits"), (F.col("i") == 0).alias("opens"), (F.col("i") == F.col("n") - 1).alias("closes"))
    single = F.array(*(F.lit(x).cast("long") for x in ENDS))
    joined = cut.join(ends, [*key, "part", "seq"], "left")
    return joined.withColumns({"exits": F.coalesce("exits", single), "opens": F.coalesce("opens", F.lit(True)), "closes": F.coalesce("closes", F.lit(True))})


def solved(planned: DataFrame) -> DataFrame:
    """Every block with `ways`: for each state it may be entered in, cost, letters and the state behind."""
    kind = "array<struct<state: int, cost: long, letters: string, behind: int>>"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for word, exits, opens, closes in zip(*(batch.column(c).to_pylist() for c in ("word", "exits", "opens", "closes"))):
                entries = (START,) if opens else (START, SYSTEM, USER, REPLY)
                found = traces(word, tuple(exits), closes, entries)
                out.append([{"state": q, "cost": c, "letters": x, "behind": b} for q, (c, x, b) in zip(entries, found)])
            fields = pa.list_(pa.struct([("state", pa.int32()), ("cost", pa.int64()), ("letters", pa.string()), ("behind", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, fields)], [*batch.schema.names, "ways"])

    names = ["known", "conv", "part", "seq", "word", "exits", "opens", "closes", "blank", "duplicate", "truncated", "illegal", "initials", "first", "last", "turns"]
    rows = planned.select(names)
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", ways {kind}")


def audits(ways: DataFrame) -> DataFrame:
    """known, conv, gaps, blank, duplicate, truncated, illegal, cost, audit, for each conversation."""

    def chain(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for parts in batch.column("b").to_pylist():
                state, letters, illegal, turns, last, tail = START, [], 0, 0, None, ""
                for x in parts:
                    way = next(w for w in x["ways"] if w["state"] == state)
                    letters.append(way["letters"])
                    state = way["behind"]
                    if x["initials"]:  # pairs and turns that two blocks share
                        illegal += bool(tail) and tail + x["initials"][0] not in ("su", "ua", "au")
                        tail = x["initials"][1]
                    if x["first"] is not None:
                        turns += x["turns"] - (x["first"] == last)
                        last = x["last"]
                out.append((parts[0]["ways"][0]["cost"], "".join(letters), illegal, turns))
            cost, audit, illegal, turns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("known", "conv", "blank", "duplicate", "truncated", "inside", "span")), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(illegal, pa.int64()), pa.array(turns, pa.int64())], ["known", "conv", "blank", "duplicate", "truncated", "inside", "span", "cost", "audit", "across", "turns"])

    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    pieces = F.sort_array(F.collect_list(F.struct("part", "seq", "initials", "first", "last", "turns", "ways"))).alias("b")
    rows = ways.groupBy("known", "conv").agg(*sums, F.sum("illegal").alias("inside"), (F.max("last") - F.min("first") + 1).alias("span"), pieces)
    rows = rows.mapInArrow(chain, "known boolean, conv long, blank long, duplicate long, truncated long, inside long, span long, cost long, audit string, across long, turns long")
    return rows.select("known", "conv", F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("inside") + F.col("across")).alias("illegal"), "cost", "audit")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """known, conv, repaired_sha256: rows in order behind their conversation's edits, read as a stream."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, h, empty = None, "", 0, START, hashlib.sha256(), True

        def put(role: str, text: str) -> None:
            nonlocal empty
            h.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                put(ROLES[GIVEN[state]], "")
                state = NEXT[state, GIVEN[state]]
                at += 1

        for batch in stream:
            done = []
            for known, conv, own, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (known, conv) != key:
                    if key is not None:
                        inserts()
                        done.append((*key, h.hexdigest()))
                    key, audit, at, state, h, empty = (known, conv), own, 0, START, hashlib.sha256(), True
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    initial = role[:1] if edit == "K" else GIVEN[state]
                    put(role if edit == "K" else ROLES[initial], text)
                    state = NEXT[state, initial]
            yield digests(done)
        if key is not None:
            inserts()
            yield digests([(*key, h.hexdigest())])

    def digests(done: Sequence[tuple]) -> pa.RecordBatch:
        known, conv, digest = zip(*done) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(known, pa.bool_()), pa.array(conv, pa.int64()), pa.array(digest, pa.string())], ["known", "conv", "repaired_sha256"])

    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"), ("copy", "int"), ("role", "string"), ("text", "string"))]
    heads = edits.select("known", "conv", F.lit(0).alias("kind"), "audit", *nothing)
    body = rows.where("not gone").select("known", "conv", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", digest.alias("digest"), "copy", "role", "text")
    dealt = heads.unionByName(body).repartition("known", "conv").sortWithinPartitions("known", "conv", "kind", "turn", "digest", "copy")
    return dealt.select("known", "conv", "audit", "role", "text").mapInArrow(run, "known boolean, conv long, repaired_sha256 string")


def structure_repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, for every conversation."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    cut = written(blocks(faults(rows), block), "blocks")
    edits = written(audits(solved(plans(cut))), "edits")
    out = edits.join(repaired(rows, edits), ["known", "conv"])
    return out.select(F.when(F.col("known"), F.col("conv")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
