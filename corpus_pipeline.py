"""The corpus pipeline: rules, near-copies, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's documents.  All but the last return the
columns of `documents`; other columns, whatever their names, are left behind.

Defined cases, in every stage: an empty table gives no rows; a null column stays null; a null or empty text has no
words, so it fails the rules, and in the other stages is nobody's copy, is clean of passages and is mixed by the
prior; rows that repeat an id are judged each by its own text; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.cluster import scratch, written
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import keep_one
from tessera.llm.mixing import mix_to_targets
from tessera.llm.quality_rules import quality_rules
from tessera.llm.queries import SHARD_BYTES, table
from tessera.llm.sharding import shard

CARRY = ("lang", "source", "n_chars")


def documents(rows: DataFrame) -> DataFrame:
    """The columns of `documents` from an operator's doc_id, text and carried columns."""
    return rows.select("doc_id", "text", *(F.col(f"carried.{c}") for c in CARRY))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines go from the rest, and n_chars follows."""
    kept = documents(quality_rules(docs, carry=CARRY).where("kept"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies stays, the one with the smallest doc_id (a null is the largest).

    Copies share 80 percent of their five-word shingles, unlike in the contract of the op9 query.  Different texts
    under one id all stay; rows without an id are copies like any other; rows without words all stay.
    """
    return keep_one(docs, k=5, percent=80).select("doc_id", "text", *CARRY)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return documents(decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=CARRY).where("not contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that the domains' tokens meet the targets."""
    mixed = mix_to_targets(docs, table(spark, sf_dir, "labels"), carry=CARRY).where("copies > 0")
    return documents(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the name of its shard."""
    return shard(docs, SHARD_BYTES)


STAGES = [("quality rules", rules), ("near copies", near_copies), ("benchmark passages", benchmark_passages), ("mixing", mixing), ("sharding", shards)]

#: The classifier of the mixing stage has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its documents are written
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
