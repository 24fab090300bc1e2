"""The registered queries of this subpackage and, where SQL can state them, their oracles.

Every query reads whole tables; digest columns are derived here from the operators' own outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .chat_format import chat_windows, read_back
from .decontaminate import decontaminate
from .jaccard_join import jaccard_join
from .license_scan import BASE, NOTICES, key_places, license_scan
from .lm_scores import lm_scores
from .mixing import mix_to_targets
from .neighbour_quality import neighbour_quality
from .prefix_trie import prefix_trie
from .quality_rules import quality_rules
from .sharding import shard
from .structure_repair import structure_repair
from .substring_dedup import substring_dedup
from .token_counts import token_counts

#: The byte limit of a shard in op2_sharding and the pipeline: small, so that the given tables split into many.
SHARD_BYTES = 64 << 10
#: op3_quality_rules rejects a document that keeps less than so many percent of its words, so that some are.
MIN_LEFT = 80
#: Tokens of a window and of its repeated history in op10_chat_format: most conversations need several windows.
CHAT_BUDGET, CHAT_HISTORY = 200, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shard(docs, SHARD_BYTES).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("shard_depth").cast("long"), "shard_prefix", "shard_part")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), min_left=MIN_LEFT).drop("text", "carried")


def op4_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text", "carried")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams, none pruned."""
    return lm_scores(table(spark, sf_dir, "documents"), order=3, min_count=1)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(r"""SELECT * FROM VALUES (-7L, 0, 'user', r'\### Assistant: </turn> ok'), (-7L, 1, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(chat_windows(turns.unionByName(extra), CHAT_BUDGET, CHAT_HISTORY))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first turns of c - c % 5."""
    base, h = F.col("conv_id") - F.col("conv_id") % 5, (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    return prefix_trie(table(spark, sf_dir, "conversations"), base, h, longest=8).drop("node")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *(F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")), "score")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_neighbour_quality": op4_neighbour_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_mixing": op6_mixing,
    "op7_lm_scores": op7_lm_scores,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_chat_format": op10_chat_format,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_license_scan": op12_license_scan,
    "op13_structure_repair": op13_structure_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": oracle.op2(SHARD_BYTES),
    "op3_quality_rules": oracle.op3(min_docs=4, max_share=10, max_docs=10_000, min_left=MIN_LEFT),
    "op5_decontaminate": oracle.op5(),
    "op7_lm_scores": oracle.op7(),
    "op8_substring_dedup": oracle.op8(),
    "op9_jaccard_join": oracle.op9(),
    "op10_chat_format": oracle.op10(CHAT_BUDGET, CHAT_HISTORY),
    "op11_prefix_trie": oracle.op11(),
    "op12_license_scan": oracle.op12([(t.label, t.words, key_places(t), t in BASE) for t in [*BASE, *NOTICES]]),
    "op13_structure_repair": oracle.op13(),
}
