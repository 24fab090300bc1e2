"""Operators against plain Python, the library they follow, or held-out labels."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import mixing, neighbour_quality, queries, sharding, token_counts
from tessera.llm.queries import ORACLE_SQL, QUERIES

from ..compare import assert_same, database


def test_oracles(spark, sf):
    db = database(sf)
    for name, sql in ORACLE_SQL.items():
        assert_same(spark, db, sf, QUERIES[name], sql)


def test_token_counts_equal_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rnd = random.Random(1)
    bits = ["a", "the", " ", "  ", "▁", "\n", " \n", "é", "漢", "😀", "\x00", "<s>", "</s>", "<0x0A>", "ing", "\t", "​"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    own = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df).collect()}
    rows = df.collect()
    assert [own[r["doc_id"]] for r in rows] == [len(x) for x in model.encode([r["text"] or "" for r in rows], num_threads=1)]


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    rows = neighbour_quality.neighbour_quality(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_mixing_tells_unmet_targets(spark):
    rows = spark.createDataFrame([(n, 1.0, 0.0, 0.0) for n in (5, 7)], "n_tokens long, p_clean double, p_low double, p_toxic double")
    _, met, goal = mixing.fit_rates(rows, mixing.TARGETS)
    assert np.allclose(met, [goal[0], 0, 0], rtol=1e-4)
    both = spark.createDataFrame([(10, 0.5, 0.25, 0.25)], rows.schema)  # one rate can't give 92, 5 and 3 percent
    steps, met, goal = mixing.fit_rates(both, mixing.TARGETS)
    current = np.array([5, 2.5, 2.5])
    best = (goal * current / current).sum() / current.sum()
    assert np.allclose(met, best * current, rtol=1e-3)


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_mixing(spark, sf).toPandas()
    p = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    met = (p * (rows["n_tokens"] * rows["rate"]).to_numpy()[:, None]).sum(0)
    assert np.allclose(met / met.sum(), np.array(mixing.TARGETS) / sum(mixing.TARGETS), atol=0.01)
    assert np.allclose(met, rows["met"][0]) and np.allclose(rows["met"][0], rows["goal"][0], rtol=1e-4)
    # the rates are those of the same descent on one machine
    goal, weighted = np.array(rows["goal"][0]), p * rows["n_tokens"].to_numpy()[:, None]
    current = weighted.sum(0)
    step = 1 / np.linalg.eigvalsh((weighted.T @ p) / np.sqrt(np.outer(current, current))).max()
    r = ahead = np.ones(len(p))
    age = 0
    while np.abs(weighted.T @ r / goal - 1).max() >= 1e-5:
        uphill = (weighted.T @ ahead - goal) / current
        new = np.maximum(0, ahead - step * (p @ uphill))
        age = 0 if weighted.T @ (new - r) @ uphill > 0 else age
        ahead, r, age = new + age / (age + 3) * (new - r), new, age + 1
    assert np.allclose(r, rows["rate"], atol=1e-6)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(rows, on="doc_id")
    assert (labels[(labels.quality == 1) & (labels.toxic == 0)].copies > 0).mean() > 0.97


def test_shards_fit_and_follow_the_directory(spark, docs):
    limit = 30_000
    rows = sharding.shard(docs, limit).withColumn("h", sharding.row_hash(docs)).withColumn("b", F.octet_length("text")).collect()
    size = lambda d, p: sum(r["b"] for r in rows if r["h"] >> (sharding.BITS - d) == p)
    for r in rows:
        d, p = r["shard_depth"], r["shard_prefix"]
        assert r["h"] >> (sharding.BITS - d) == p
        members = [x for x in rows if x["h"] >> (sharding.BITS - d) == p]
        assert size(d, p) <= limit or len(members) == 1
        assert d == 0 or size(d - 1, p >> 1) > limit


def test_votes_equal_plain_cosines(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    model = neighbour_quality.fit(read("documents"), read("labels"))
    texts = read("documents").where("doc_id % 11 = 0 and text <> ''").toPandas()
    own = {r["doc_id"]: r["score"] for r in neighbour_quality.neighbour_quality(read("documents"), read("labels")).collect()}
    assert abs(np.linalg.norm(model.vectors, axis=1) - 1).max() < 1e-4
    for i, text in zip(texts["doc_id"], texts["text"]):
        v = model.project(neighbour_quality.terms(pa.array([text])))[0]
        cos = np.array([float(np.dot(v, u)) for u in model.vectors])
        near = np.argsort(-cos, kind="stable")[: model.k]
        assert abs((cos[near] * model.labels[near]).sum() / cos[near].sum() - own[i]) < 1e-3
