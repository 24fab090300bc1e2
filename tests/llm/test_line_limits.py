"""Line frequency: documents are counted, and both limits and both plans give what plain Python gives."""

import random

import pytest

from tessera.llm import quality_rules
from tessera.llm.queries import MIN_LEFT, QUERIES

SCHEMA = "doc_id long, text string, source string"


def test_copies_push_a_line_over_the_limit(spark):
    line = " ".join("word" + "x" * i for i in range(30))
    rest = [" ".join("ownword" + "abcdefgh"[d] * (i + 1) for i in range(60)) for d in range(8)]
    rows = [(d, f"{rest[0]}\n{line}" if d < 6 else rest[d], "h") for d in range(8)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[d]["n_removed_words"] for d in range(8)] == [90] * 6 + [0, 0]
    assert [out[d]["kept"] for d in range(8)] == [False] * 6 + [True, True]


def expected(rows, min_docs, max_share, max_docs):
    held, docs = {}, {}
    norm = lambda x: " ".join("".join("0" if c in "0123456789" else c for c in x.lower()).split())
    for d, t, s in rows:
        docs[s] = docs.get(s, 0) + 1
        for x in {norm(x) for x in (t or "").split("\n")} - {""}:
            held[s, x] = held.get((s, x), 0) + 1
    over = {k for k, n in held.items() if n > min_docs and (n * 100 > docs[k[0]] * max_share or n > max_docs)}
    return {d: (sum(len(x.split()) for x in (t or "").split("\n") if (s, norm(x)) in over), "\n".join(x for x in (t or "").split("\n") if (s, norm(x)) not in over)) for d, t, s in rows}


@pytest.mark.parametrize("lines", [1_000_000, 0])
def test_limits_against_plain_counts(spark, monkeypatch, lines):
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", lines)
    monkeypatch.setattr(quality_rules, "LOT_LINES", 50)
    rnd = random.Random(2)
    rows = [(d, "\n".join(rnd.choice([f"Line {rnd.randrange(9)} of  many", f"seldom {rnd.randrange(90)}x", "Common LINE", ""]) for _ in range(rnd.randrange(12))) if d % 17 else None, rnd.choice(["a", "a", "a", "b", None])) for d in range(300)]
    out = {r["doc_id"]: (r["n_removed_words"], r["text"] or "") for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 40, 45).collect()}
    assert out == expected(rows, 4, 40, 45)


def test_depleted_documents_of_the_tables_are_rejected(spark):
    rows = QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01").where("not base_failed").collect()
    depleted = [r for r in rows if 100 * (r["n_words"] - r["n_removed_words"]) < MIN_LEFT * r["n_words"]]
    assert depleted and all(not r["kept"] for r in depleted) and sum(r["kept"] for r in rows) == len(rows) - len(depleted)
