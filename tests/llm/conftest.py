import pytest

ODD = [
    (None, None, "en", "h1", 0, 1), (None, "null id text of five words", "en", None, 0, 2), (1, "", "en", "h1", 0, 3), (2, "   \n\t ", None, "h1", None, 4), (3, "one", "en", "h1", 3, 5),
    (4, "Same text again " * 30, "en", "h1", 0, 6), (5, "Same text again " * 30, "en", "h2", 0, 7), (5, "Same text again " * 30, "en", "h2", 0, 7), (6, "long " + "word%d " * 3 % (1, 2, 3) + " ".join(f"w{i}é漢" for i in range(40_000)), "en", "h1", 0, 8),
    (7, "▁ a  b \x00 </turn> ### \\ 😀\r\n", "en", "h1", 0, 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(*r, r[5], r[5], "x", r[5]) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, n long, node long, key long, carried string, label long")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
