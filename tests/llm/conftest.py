import pytest

#: Nulls, empty and blank texts, repeated rows, equal ids, a long text, and columns named like results.
WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(WORDS[:60])
LONG = " ".join(f"long{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (1, BASE, "en", "a", 1, "x"),
    (2, BASE, "en", "b", 1, "x"),
    (2, BASE, "en", "b", 1, "x"),
    (3, BASE.replace("w30", "other"), "en", "a", 1, "x"),
    (4, " ".join(WORDS[100:160]), "de", "c", 1, "x"),
    (5, None, None, None, None, None),
    (6, "", "de", "a", 1, "x"),
    (7, " \t\n ", "de", "a", 1, "x"),
    (8, LONG, "de", "b", 1, "x"),
    (9, "Two Words", "en", None, 1, "x"),
    (10, "two  words", "en", "", 1, "x"),
    (None, BASE, "en", "a", 1, "x"),
    (11, "123 456 !!", "en", "a", 1, "x"),
    (12, "É à ñ\nline\r\n  line ", "fr", "c", 1, "x"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words int, size string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
