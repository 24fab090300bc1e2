"""Trigram scores against plain Python, with and without pruning."""

import math
from collections import Counter

import pytest

from tessera.llm import lm_scores
from tessera.llm.queries import ORACLE_SQL, QUERIES

from ..compare import assert_same, database

TEXTS = ["a b c d a b c", "A B c", "b c d a", "a b", "a", "b c", "", None, "x a b c d e", "c", "a b c d a b c", "q r s q r s q", "a b a b a b c"]


def log(c):
    return math.floor(math.log10(c) * 1_000_000 + 0.5)


def expected(texts, order, min_count):
    words = [(t or "").lower().split() for t in texts]
    count = {n: Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)}
    total = sum(map(len, words))

    def score(gram):
        if len(gram) == 1:
            return log(count[1][gram]) - log(total)
        c, context = count[len(gram)][gram], count[len(gram) - 1][gram[:-1]]
        return log(c) - log(context) if c >= min_count else -397_940 + score(gram[1:])

    return [(len(w), sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for w in words]


@pytest.mark.parametrize("order,min_count", [(3, 1), (3, 2), (1, 1), (2, 1), (4, 1)])
def test_scores_equal_plain_python(spark, order, min_count):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = lm_scores.lm_scores(docs, order, min_count).orderBy("doc_id").collect()
    assert [(r["n_words"], r["score_micro"]) for r in rows] == expected(TEXTS, order, min_count)


def test_the_registered_query_scores_trigrams(spark, sf):
    assert_same(spark, database(sf), sf, QUERIES["op7_lm_scores"], ORACLE_SQL["op7_lm_scores"])


def test_small_lots_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "LOT_WORDS", 7)
    monkeypatch.setattr(lm_scores, "HOT", 9)
    monkeypatch.setattr(lm_scores, "PARTITION_GRAMS", 11)
    texts = [" ".join("abcdefg"[(i * j * j + j) % 7] for j in range(i % 13)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lm_scores.lm_scores(docs).orderBy("doc_id").collect()
    assert [(r["n_words"], r["score_micro"]) for r in rows] == expected(texts, 3, 1)
