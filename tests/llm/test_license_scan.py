"""Licence places, labels and scores against plain Python, on odd and on planted texts."""

import math
import random
import re

import pytest

from tessera.llm.license_scan import BASE, NOTICES, key_places, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, label string, places long, score string, own long"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts):
    docs = [words(t) for t in texts]
    templates = [(t, t.words.split(), key_places(t), t in BASE) for t in [*BASE, *NOTICES]]
    held = {w: sum(w in set(d) for d in docs) for _, own, _, _ in templates for w in own}
    idf = {w: max(1, math.floor(math.log10((len(docs) + 1) / (n + 1)) * 1e6 + 0.5)) for w, n in held.items()}
    out = []
    for d in docs:
        places = []
        for t, own, keys, base in templates:
            for s in range(-len(own), len(d)):
                if all(0 <= s + q < len(d) and d[s + q] == own[q] for q in keys):
                    score = sum(idf[w] for q, w in enumerate(own) if 0 <= s + q < len(d) and d[s + q] == w) * 10**6 // sum(idf[w] for w in own)
                    places.append((s, t.label, score, base))
        own = [p for p in places if p[3]]
        out.append((len(d), len(own), min((p[0] for p in own), default=None), max((p[0] for p in own), default=None), sorted({p[1] for p in own}), sorted({p[1] for p in places}), max((p[2] for p in places), default=0) / 10**6))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    out = [None, "", " .,\n", "cc by", "CC BY cc-by CC.by ccby", "All rights\nreserved. all rights all rights reserved", "by cc by by", "İ AGNU General Public License", "GNU GENERAL PUBLIC LICENSE, version 3", "x " * 40_000 + "licensed under the Apache License, Version 2.0"]
    parts = [*(t.words for t in [*BASE, *NOTICES]), *(k for t in NOTICES for k in t.keys), "filler", "license", "public", "rights", "version 3", "2 0", "gnu", "granted", "é漢 漢", "permission is hereby"]
    for _ in range(400):
        own = " ".join(rnd.choice(parts) for _ in range(rnd.randrange(12))).split()
        for _ in range(rnd.randrange(3)):
            if own:
                own[rnd.randrange(len(own))] = rnd.choice(["Other", "license", "by"])
        out.append(rnd.choice([" ", ", ", "\n", " -- "]).join(w.upper() if rnd.random() < 0.3 else w for w in own))
    return [*out, out[-1], out[-1]]


def test_equals_plain_python(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in license_scan(df).collect()}
    want = dict(enumerate(plain(texts)))
    assert got == want
    assert {x for w in want.values() for x in w[5]} == {t.label for t in [*BASE, *NOTICES]} and max(w[1] for w in want.values()) > 3


def test_odd_rows(spark, odd):
    rows = license_scan(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0 and r["labels"] == [] and r["first_word"] is None for r in rows)
    assert license_scan(odd.limit(0)).count() == 0
    # a corpus whose every document is the notice gives its words no weight, and the scores stay defined
    same = spark.createDataFrame([(i, "All rights reserved", "x", 1, "y", 2) for i in range(3)], SCHEMA)
    assert [r["score"] for r in license_scan(same).collect()] == [1.0] * 3


def test_keys_stand_in_their_notices():
    for t in [*BASE, *NOTICES]:
        own = t.words.split()
        assert sorted({w for k in t.keys for w in k.split()}) == sorted({own[q] for q in key_places(t)}) and t.words == t.words.lower()
