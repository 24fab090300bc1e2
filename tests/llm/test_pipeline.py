"""The pipeline's stages, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, quality_rules
from tessera.llm.cluster import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near copies", "benchmark passages", "mixing", "sharding"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), "stage")
        out[name] = docs
        assert docs.columns[:5] == COLUMNS
        if name != "sharding":
            assert docs.columns == COLUMNS
        ids, was = ({r[0] for r in d.select("doc_id").collect()} for d in (docs, before))
        assert ids <= was
        if name == "quality rules":
            assert ids == {r["doc_id"] for r in quality_rules.quality_rules(before).where("kept").collect()}
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "near copies":
            assert ids == {r["component_id"] for r in jaccard_join.jaccard_join(before, k=5, percent=80).collect()} and docs.count() == len(ids)
        if name == "benchmark passages":
            bench = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert was - ids == {r["doc_id"] for r in decontaminate.decontaminate(before, bench).where("contaminated").collect()}
    assert corpus_pipeline.run(spark, sf).count() == out["sharding"].count()
