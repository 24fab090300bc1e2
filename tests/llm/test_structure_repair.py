"""Repairs against a plain search over all edits, in blocks of a few rows and whole, on odd conversations."""

import hashlib
import random
import re
import zlib

import pytest

from tessera.llm.structure_repair import ENDS, START, passage, structure_repair, traces

SCHEMA = "conv_id long, turn long, role string, text string, known string, conv long, digest string"
SPACE = " \t\n\v\f\r"


def cheapest(rows):
    """(cost, letters, turns) by dynamic programming over tuples, forwards; rows are (role, text, fault)."""

    def closed(states):
        for q, role, to in (("e", "user", "u"), ("s", "user", "u"), ("a", "user", "u"), ("u", "assistant", "a"), ("a", "user", "u")):
            if q in states:
                c, letters, turns = states[q]
                new = (c + 5, letters + "I", (*turns, f"{role}:"))
                states[to] = min(states.get(to, new), new)
        return states

    follow = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    states = closed({"e": (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for q, (c, letters, turns) in states.items():
            options = [(q, (c + 2, letters + "D", turns))]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (q, role[:1]) in follow:
                    options.append((follow[q, role[:1]], (c + extra, letters + "K", (*turns, f"{role}:{text}"))))
                for other in ("user", "assistant"):
                    if (q, other[0]) in follow:
                        options.append((follow[q, other[0]], (c + 1 + extra, letters + "R", (*turns, f"{other}:{text}"))))
            for to, x in options:
                new[to] = min(new.get(to, x), x)
        states = closed(new)
    return min(states[q] for q in "ea" if q in states)


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        out = convs.setdefault(c, [])
        damage = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        role = "user" if damage == 4 else role
        for copy in range(0 if damage == 0 else 2 if damage == 3 else 1):
            out.append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest(), copy, role, text))
    result = []
    for c, own in convs.items():
        own.sort()
        seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for *_, role, text in own:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else None if text.rstrip(SPACE)[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role, text, fault))
        turns = [t for has, t, *_ in own if has]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, fixed = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result.append((c, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest()))
    return sorted(result, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    role = lambda: rnd.choice(["user", "assistant", "system", "tool", "", None, "Umbrella", "user"])
    text = lambda: rnd.choice(["Yes.", "no", "", " \t", "What?\n", "wait…", "é漢!", None, f"say {rnd.random()}."])
    out = [(c, rnd.choice([None, *range(8)]), role(), text()) for c in range(60) for _ in range(rnd.randrange(1, 9))]
    out += [(100, t, role(), text()) for t in range(300)]
    out += [(101, t, "user", f"again {t % 3}.") for t in range(200)] + [(102, t // 2, rnd.choice(["user", "assistant"]), f"{t}.") for t in range(150)]
    out += [(c, 0, "user", "x" * 50_000 + ".") for c in range(200, 240)] + [(None, t, "user", "lost.") for t in (None, 1, 1)]
    out += [(103, 4, "user", "tie.")] * 40
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("block", [3, 128])
def test_equals_plain_python(spark, rows, block):
    own = structure_repair(spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA), block).collect()
    assert sorted((tuple(r) for r in own), key=str) == plain(rows)


def test_no_conversations(spark):
    assert structure_repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_traces_equal_a_plain_search():
    rnd = random.Random(2)
    meant = {"s": ("system", None), "u": ("user", None), "a": ("assistant", None), "x": ("tool", None), "-": ("user", "blank")}
    for _ in range(2000):
        word = "".join(rnd.choice("suaxSUAX-") for _ in range(rnd.randrange(12)))
        rows = [(meant[x.lower()][0], "t", "truncated" if x.isupper() else meant[x.lower()][1]) for x in word]
        ((cost, letters, state),) = traces(word, ENDS, True, (START,))
        assert (cost, letters) == cheapest(rows)[:2] and state in (0, 3)


def test_passages_add_up():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("suaxSUAX-") for _ in range(rnd.randrange(1, 6))) for _ in range(2))
        first, second, whole = passage(a), passage(b), passage(a + b)
        assert whole == [min(1 << 40, *(first[4 * q + k] + second[4 * k + to] for k in range(4))) for q in range(4) for to in range(4)]
