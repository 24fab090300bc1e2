"""The trie against plain Python, with components split down to a few nodes, on odd conversations."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie
from tessera.llm.prefix_trie import decompose, prefix_trie as trie


def rules():
    return F.col("conv_id") - F.col("conv_id") % 5, (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
SCHEMA = "conv_id long, turn long, role string, text string, node string, comp long, parent string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest()


def plain(rows):
    """What the contract asks for, node by node."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    whole = {}
    for c in own:
        base, h = c - int(np.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(t[3:] for t in own.get(base, [])[:h]) + tuple(t[3:] for t in own[c][h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in convs if whole[c] == path))
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids(path)), sum(not kids(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice("ab")) for c in range(40) for t in range(rnd.randrange(1, 12))]
    out += [(c, t, "user", f"é漢 {t}") for c in (50, 51, 52, 53, 54, -3, -7) for t in range(60)]  # long chains
    out += [(c, t, "user", "hot") for c in range(100, 130) for t in range(10)]  # copies
    out += [(200, None, "user", "late"), (200, 1, None, None), (200, 1, None, None), (200, 1, "user", "tie"), (None, 1, "user", "nowhere"), (203, 0, "user", ""), (201, 5, "user", "long " * 20_000)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("limit", [1, 7, 1_000])
def test_equals_plain_python(spark, rows, limit):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = trie(table(spark, rows), *rules(), 8, limit).select(names).collect()
    assert sorted((tuple(r) for r in own), key=str) == plain(rows)


def test_nothing_and_no_turns(spark):
    assert trie(table(spark, []), *rules(), 8).count() == 0
    assert trie(table(spark, [(None, 1, "user", "a")]), *rules(), 8).count() == 0
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    (row,) = trie(table(spark, [(c, 0, "user", "a")]), *rules(), 8).collect()  # its own turn is skipped, nothing begins it
    assert (row["conv_id"], row["depth"], row["n_convs"], row["n_leaves"], row["ends_sha256"]) == (c, 0, 1, 1, hashlib.sha256(str(c).encode()).hexdigest())


def test_decompose_sums_subtrees():
    rnd = random.Random(5)
    for n in (1, 2, 3, 50, 400):
        parent = [0, *(rnd.randrange(max(0, i - 3), i) for i in range(1, n))]
        values = np.array([[rnd.randrange(9), 1] for _ in range(n)])
        want = values.copy()
        for i in range(n - 1, 0, -1):
            want[parent[i]] += want[i]
        assert (decompose(parent, values) == want).all()


def test_rounds_follow_the_logarithm(spark, rows, monkeypatch):
    seen = []
    first = prefix_trie.lookup
    monkeypatch.setattr(prefix_trie, "lookup", lambda *a, **b: seen.append(1) or first(*a, **b))
    trie(table(spark, [(50, t, "user", f"{t}") for t in range(256)]), F.col("conv_id"), F.lit(0), 8, 4).count()
    assert len(seen) <= 4 * 9
