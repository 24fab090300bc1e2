"""Texts that alternate two pieces in the Thue-Morse order and its opposite cancel in polynomials modulo a power of two."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.lm_scores import lm_scores
from tessera.llm.quality_rules import quality_rules
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.text import Words, byte_hashes, content_of, run_hashes

BITS = [bin(i).count("1") % 2 for i in range(2048)]


def pair(a, b, sep="", n=2048):
    return sep.join((a, b)[x] for x in BITS[:n]), sep.join((b, a)[x] for x in BITS[:n])


def test_runs_differ():
    for a, b in (("a", "b"), ("ab", "cd"), ("é", "x")):
        assert len(set(Words(pa.array(pair(a, b))).hashes().tolist())) == 2
    w = Words(pa.array(pair("one", "two", " ")))
    assert len(set(content_of(w, w.hashes()).tolist())) == 2
    values = np.array([3, 5, 3, 5, 7], np.uint64)
    long_runs = np.frombuffer(bytes(BITS) * 3, np.uint8)
    at = np.arange(0, 2048, 7)
    assert len(set(byte_hashes(long_runs, at, at + 2048).tolist())) == len({long_runs[i : i + 2048].tobytes() for i in at})
    h = run_hashes(values, np.array([0, 2, 1, 4, 4]), np.array([2, 4, 3, 4, 5]))
    assert h[0] == h[1] and len(set(h.tolist())) == 4


@pytest.fixture(scope="module")
def texts(spark):
    lines = "\n".join(pair("x", "y"))
    words = pair("alpha", "beta", " ")
    long_words = " ".join(pair("p", "q"))
    rows = [lines, *words, long_words, pair("p", "q")[1], "\n".join((*pair("x", "y"), pair("x", "y")[0]))]
    return spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_lines(texts):
    assert [r[0] for r in quality_rules(texts).orderBy("doc_id").select("n_dup_lines").collect()] == [0, 0, 0, 0, 0, 1]


def test_windows_of_benchmark(spark, texts):
    items = spark.createDataFrame([("i", " ".join(pair("alpha", "beta", " ")[0].split()[1018:1031]))], "item_id string, text string")
    own = {r["doc_id"]: r["n_hit"] for r in decontaminate(texts, items).collect()}
    plain = {}
    item = items.first()["text"].split()
    grams = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    for doc_id, text in texts.select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        plain[doc_id] = len({j for i in range(len(words) - 12) if tuple(words[i : i + 13]) in grams for j in range(i, i + 13)})
    assert own == plain and plain[1] > 0


def test_scores_tell_texts_apart(texts):
    extra = texts.where("doc_id = 1").withColumn("doc_id", F.lit(7).cast("long"))
    own = {r["doc_id"]: r["score_micro"] for r in lm_scores(texts.unionByName(extra)).collect()}
    assert own[1] == own[7] and own[1] != own[2]


def test_copies(texts):
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join(texts.where("doc_id in (0, 3, 4)")).collect()} == {0: 0, 3: 3, 4: 4}
    rows = {r["doc_id"]: r["n_removed"] for r in substring_dedup(texts.where("doc_id in (1, 2)")).collect()}
    a, b = (t.split() for t in pair("alpha", "beta", " "))
    grams = {tuple(a[i : i + 50]) for i in range(len(a) - 49)}
    assert rows == {1: 0, 2: len({j for i in range(len(b) - 49) if tuple(b[i : i + 50]) in grams for j in range(i, i + 50)})}
