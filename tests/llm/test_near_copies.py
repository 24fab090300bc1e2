"""The near-copies stage against brute force over five-word shingles at 0.8."""

import random
from fractions import Fraction

import corpus_pipeline


def test_stage_removes_copies_at_five_words_and_four_fifths(spark, sf):
    rnd = random.Random(3)
    texts = {}
    for i in range(30):
        words = [f"w{rnd.randrange(10_000)}" for _ in range(60)]
        texts[10 * i] = " ".join(words)
        for j in range(1, 4):  # some words changed at the end: similarity from far under to over 0.8
            other = list(words)
            for at in range(rnd.randrange(1, 12)):
                other[-1 - at] = f"v{rnd.randrange(10_000)}"
            texts[10 * i + j] = " ".join(other)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in texts.items() for w in [t.split()]}
    lowest = {d: d for d in texts}
    apart = True
    while apart:
        apart = False
        for a in texts:
            for b in range(a - a % 10, a - a % 10 + 4):
                if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(4, 5) and lowest[b] < lowest[a]:
                    lowest[a], apart = lowest[b], True
    rows = [(d, t, "en", "h", len(t)) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, sf).collect()} == set(lowest.values())
