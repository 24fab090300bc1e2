"""Each stage of the pipeline on odd rows, repeated ids and empty tables."""

import corpus_pipeline
import pytest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows_and_empty_tables(spark, odd, sf, name):
    docs = odd.select(*COLUMNS, "n", "node", "key", "carried", "label") if name != "sharding" else odd
    out = STAGES[name](spark, docs, sf)
    rows = [r.asDict() for r in out.collect()]
    if name == "near copies":
        assert set(COLUMNS) <= set(out.columns)
    elif name != "sharding":
        assert out.columns == COLUMNS
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:9]) for r in rows)
    if name == "quality rules":
        assert {r["doc_id"] for r in rows} == {6} and len(rows[0]["text"]) > 250_000
    if name == "near copies":  # 4 stands for 5 and 5
        assert texts == [(False, 1, ""), (False, 2, "   \n\t "), (False, 3, "one"), (False, 4, "Same text"), (False, 6, "long word"), (False, 7, "▁ a  b \x00 "), (True, 0, ""), (True, 0, "null id t")]
    if name in ("benchmark passages", "sharding"):
        assert len(rows) == odd.count()
    assert STAGES[name](spark, docs.limit(0), sf).count() == 0


def test_repeated_ids_and_rows_without_one(spark, sf):
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, words("a")), (1, words("b")), (2, words("b")), (None, words("c")), (None, words("c")), (None, words("a")), (3, words("c") + " x"), (4, words("d")), (4, words("d"))]
    docs = spark.createDataFrame([(d, t, "en", "h", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = sorted((r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_copies(spark, docs, sf).collect())
    assert kept == [(1, "a"), (1, "b"), (3, "c"), (4, "d")]
