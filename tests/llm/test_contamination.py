"""Decontamination against plain windows, by both plans."""

import random

import corpus_pipeline
import pytest

from tessera.llm import cluster, decontaminate
from tessera.llm.queries import QUERIES


def expected(texts, items, size=13, percent=5):
    split = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    windows = [(i, tuple(w[j : j + min(size, len(w))])) for i, t in items for w in [split(t)] if w for j in range(len(w) - min(size, len(w)) + 1)]
    out = {}
    for d, t in texts:
        w, hit, names = split(t), set(), set()
        for i, g in windows:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= {*range(s, s + len(g))}
                    names |= {str(i)} - {"None"}
        out[d] = (len(w), len(hit), sorted(names), bool(hit) and 100 * len(hit) >= percent * len(w))
    return out


@pytest.mark.parametrize("large", [False, True])
def test_against_plain_windows(spark, monkeypatch, large):
    if large:  # nothing is small enough to be broadcast
        monkeypatch.setattr(decontaminate, "BROADCAST_FOUND", -1)
        monkeypatch.setattr(decontaminate, "lookup", lambda big, small, key, how="left", **_: cluster.lookup(big, small, key, how, broadcast_rows=-1))
        monkeypatch.setattr(decontaminate, "LOT_TOKENS", 10)
    rnd = random.Random(4)
    word = lambda: f"W{rnd.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 5, 12, 13, 14, 30])))) for i in range(14)]
    items += [(90, items[0][1]), (91, ""), (92, None), (93, "Lone"), (None, "nameless item of just seven words"), (94, items[5][1] + " tail")]
    texts = []
    for d in range(80):
        words = [word() for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            words += (rnd.choice(items)[1] or "").upper().split()[rnd.randrange(2) :] + [word(), "-", "lone!"][: rnd.randrange(4)]
        texts.append((d, ", ".join(words)))
    texts += [(100, texts[5][1]), (101, None), (102, ""), (103, "NAMELESS item, of: just seven words")]
    rows = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows} == expected(texts, items)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pipeline_stage_broadcasts_nothing_found_beyond_the_bound(spark, sf, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_FOUND", 0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.benchmark_passages(spark, docs, sf)
    assert "Broadcast" not in planned(kept)
    clean = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated")
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in clean.collect()) and 0 < len(ids) < docs.count()


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_lookup_is_a_merge(spark, how):
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, None])], "key long, n int")
    small = cluster.written(spark.createDataFrame([(1, [7, 8]), (3, []), (None, [9])], "key long, found array<int>"), "small")
    joined = cluster.lookup(big, small, "key", how, broadcast_rows=0)
    assert "Broadcast" not in planned(joined)
    found = {1: [7, 8], 3: []}
    expected = [(k, i, found.get(k)) for i, k in enumerate([1] * 50 + [2, 3, None]) if how == "left" or k in found]
    assert sorted(((r["key"], r["n"], r["found"]) for r in joined.collect()), key=lambda r: r[1]) == expected


def test_op5_is_the_same_without_broadcasts(spark, sf, monkeypatch):
    op5 = QUERIES["op5_decontaminate"]
    small = op5(spark, sf)
    assert "BroadcastHashJoin" in planned(small)
    monkeypatch.setattr(decontaminate, "BROADCAST_FOUND", 0)
    large = op5(spark, sf)
    assert "Broadcast" not in planned(large)
    rows = sorted(large.collect())
    assert rows == sorted(small.collect()) and any(r["n_items"] for r in rows)
