"""Matching statistics against plain search, and substring removal through them."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import fm_index, substring_dedup


def plain(pieces, docs, words, cap):
    """(longest match up to cap, smallest doc of a match of cap) at each place of a pattern."""
    out = []
    for i in range(len(words)):
        longest, doc = 0, fm_index.NO_DOC
        for p, d in zip(pieces, docs):
            for j in range(len(p)):
                m = 0
                while m < cap and i + m < len(words) and j + m < len(p) and p[j + m] == words[i + m]:
                    m += 1
                longest = max(longest, m)
                if m == cap:
                    doc = min(doc, d)
        out.append((longest, doc))
    return out


@pytest.mark.parametrize("seed,letters,cap", [(1, 2, 5), (2, 3, 8), (3, 6, 3), (4, 2, 20), (5, 40, 4)])
def test_matching_statistics(seed, letters, cap):
    rnd = random.Random(seed)
    some = lambda n: np.array([rnd.randrange(1, letters + 1) for _ in range(n)], np.int64)
    pieces = [some(rnd.randrange(1, 40)) for _ in range(12)] + [some(1)]
    docs = np.array([rnd.randrange(100) for _ in pieces], np.int64)
    index = fm_index.FMIndex(pieces, docs, letters + 1, cap)
    patterns = [some(rnd.randrange(1, 60)) for _ in range(8)]  # documents that the index has never seen
    patterns += [np.concatenate([pieces[3], pieces[5], np.array([0]), pieces[0]]), np.zeros(3, np.int64)]
    start = np.cumsum([0] + [len(p) for p in patterns[:-1]])
    found, doc = index.match(np.concatenate(patterns), start, np.array([len(p) for p in patterns]))
    expected = [x for p in patterns for x in plain(pieces, docs, p, cap)]
    assert list(zip(found.tolist(), doc.tolist())) == expected


def test_a_mismatch_shrinks_the_match():
    index = fm_index.FMIndex([np.array([1, 2, 3, 4, 5, 6])], np.array([7]), 8, 4)
    found, doc = index.match(np.array([2, 3, 4, 7, 3, 4, 5, 6]), np.array([0]), np.array([8]))
    assert found.tolist() == [3, 2, 1, 0, 4, 3, 2, 1]
    assert doc.tolist() == [fm_index.NO_DOC] * 4 + [7] + [fm_index.NO_DOC] * 3


def test_results_come_through_the_wavelet_matrix(monkeypatch):
    pieces = [np.array([1, 2, 3, 1, 2, 4])]
    whole = fm_index.FMIndex(pieces, np.array([1]), 5, 3)
    monkeypatch.setattr(fm_index.Wavelet, "rank", lambda self, c, at: np.zeros(len(c), np.int64))
    broken = fm_index.FMIndex(pieces, np.array([1]), 5, 3)
    words, start, length = np.array([1, 2, 3]), np.array([0]), np.array([3])
    assert broken.match(words, start, length)[0].tolist() != [3, 2, 1]
    monkeypatch.undo()
    assert whole.match(words, start, length)[0].tolist() == [3, 2, 1]


def removed(texts, size):
    seen, out = {}, {}
    for d, t in texts.items():
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            seen[g] = min(seen.get(g, d), d)
    for d, t in texts.items():
        w = (t or "").split()
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] < d for j in range(i, i + size)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_removal_against_plain_windows(spark, monkeypatch, small):
    if small:  # many indexes a shard, hot keys and cut regions
        for name, value in (("INDEX_WORDS", 300), ("SHARD_WORDS", 4000), ("LEAST_HOT", 3), ("HOT", 5), ("REGION", 7)):
            monkeypatch.setattr(substring_dedup, name, value)
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 120))] for _ in range(12)]
    texts = {}
    for d in rnd.sample(range(1000), 120):
        words = []
        for _ in range(rnd.randrange(4)):
            words += [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "changed"
            words += p[rnd.randrange(10) :]
        texts[d] = " ".join(words)
    texts[1001], texts[1002], texts[1003] = "again " * 900, "again " * 700 + "x", "a b " * 300
    texts[1004] = texts[1003]
    rows = substring_dedup.substring_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == removed(texts, 50)
