"""Each operator on odd rows and on empty tables gives its defined result."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, jaccard_join, lm_scores, mixing, neighbour_quality, quality_rules, sharding, substring_dedup, token_counts


def bench(spark):
    return spark.createDataFrame([(1, "Same text again " * 5, 0), (2, None, 0), (3, "", 0), (4, "one", 0)], "item_id long, text string, n int")


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (1, 1, 0), (4, 1, 0), (None, 1, 1), (6, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")


APPLY = {
    "tokens": lambda d, s: token_counts.token_counts(d),
    "rules": lambda d, s: quality_rules.quality_rules(d),
    "quality": lambda d, s: neighbour_quality.neighbour_quality(d, labels(s)),
    "benchmark": lambda d, s: decontaminate.decontaminate(d, bench(s)),
    "mixing": lambda d, s: mixing.mix_to_targets(d, labels(s)),
    "lm": lambda d, s: lm_scores.lm_scores(d),
    "substring": lambda d, s: substring_dedup.substring_dedup(d),
    "jaccard": lambda d, s: jaccard_join.jaccard_join(d),
    "shards": lambda d, s: sharding.shard(d, 1000),
}


@pytest.mark.parametrize("name", APPLY)
def test_odd_rows_keep_their_number(spark, odd, name):
    rows = APPLY[name](odd, spark).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[5]) == 2
    if name == "tokens":
        assert (by[1][0]["n_tokens"], by[1][0]["n_bytes"]) == (0, 0) and by[6][0]["over_limit"]
    if name == "rules":
        assert by[2][0]["n_words"] == 0 and not by[2][0]["kept"] and by[6][0]["kept"]
    if name == "quality":
        assert all(0 <= r["score"] <= 1 for r in rows) and by[None][0]["held_out"] is None
    if name == "benchmark":
        assert by[4][0]["contaminated"] and by[3][0]["items"] == ["4"] and not by[1][0]["contaminated"]
    if name == "mixing":
        assert all(r["rate"] >= 0 and r["copies"] >= 0 for r in rows)
    if name == "lm":
        assert by[1][0]["score"] == 0.0 and by[5][0]["score_micro"] == by[4][0]["score_micro"]
    if name == "substring":
        assert [r["n_removed"] for r in by[5]] == [90, 90] and by[4][0]["n_removed"] == 0 and by[6][0]["n_removed"] == 0
    if name == "jaccard":
        assert [r["component_id"] for r in by[5]] == [4, 4] and by[1][0]["component_id"] == 1 and by[1][0]["n_shingles"] == 0
    if name == "shards":
        assert {"doc_id", "text", "n", "node", "key", "carried", "label"} < set(rows[0].asDict())


@pytest.mark.parametrize("name", APPLY)
def test_empty_tables_give_no_rows(spark, odd, name):
    assert APPLY[name](odd.limit(0), spark).count() == 0


def test_empty_side_tables(spark, odd):
    assert decontaminate.decontaminate(odd, bench(spark).limit(0)).where("contaminated").count() == 0
    assert {r["score"] for r in neighbour_quality.neighbour_quality(odd, labels(spark).limit(0)).collect()} == {0.5}
    assert mixing.mix_to_targets(odd, labels(spark).limit(0)).count() == odd.count()


def test_oversized_equal_rows_are_dealt_to_parts(spark, odd):
    hot = odd.where("doc_id = 4")
    many = hot.crossJoin(spark.range(50)).drop("id")
    rows = sharding.shard(many.unionByName(odd), 2000).groupBy(*sharding.SHARD_COLUMNS).agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in rows) == 50 + odd.count()
    assert all(r["b"] is None or r["b"] <= 2000 or r["n"] == 1 for r in rows)


def test_chat_round_trip_and_budget(spark):
    text = "\\### Assistant: </turn> ok \\h \\b\\l <#>"
    rows = [(1, 0, "system", "be brief", 0), (1, None, None, None, 0), (None, 1, "user", text, 0), (None, 2, "assistant", text, 0), (None, 2, "assistant", text, 0)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"turn {i} " * (i * 11 % 90), 0) for i in range(40)] + [(3, 0, "system", "rules here", 0)] + [(3, i, "assistant\n" if i == 3 else "assistant", "w " * (600 if i == 5 else 70), 0) for i in range(1, 12)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, window int")
    windows = chat_format.chat_windows(turns, budget=200, history=50).collect()
    assert all(w["n_tokens"] <= 200 or w["n_repeated"] <= 1 for w in windows)
    assert all(w["text"].startswith("### system\nrules here</turn>\n") for w in windows if w["conv_id"] == 3)
    whole = chat_format.read_back(chat_format.chat_windows(turns, budget=200, history=50)).collect()
    back = {r["conv_id"]: r for r in whole if r["conv_id"] is not None}
    for conv in (1, 2, 3):
        own = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        assert back[conv]["n_turns"] == len(own)
        assert back[conv]["loss_chars"] == sum(len(x) for _, r, x in own if r == "assistant")
    assert sorted((r["n_turns"], r["loss_chars"]) for r in whole if r["conv_id"] is None) == [(1, 0), (1, len(text)), (1, len(text))]
    assert chat_format.chat_windows(turns.limit(0)).count() == 0


def test_a_very_long_turn_and_a_very_long_conversation(spark):
    rows = [(1, 0, "user", "word " * 300_000), (1, 1, "assistant", "yes")] + [(2, i, "assistant" if i % 2 else "user", f"t{i} and some more") for i in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    windows = chat_format.chat_windows(turns, budget=200, history=50)
    assert windows.where("conv_id = 1").count() == 2 and windows.where("conv_id = 2 and n_repeated > 0").count() > 50
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat_format.read_back(windows).collect()} == {(1, 2, 3), (2, 3000, sum(len(x) for _, _, r, x in rows[2:] if r == "assistant"))}
