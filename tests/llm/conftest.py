import pytest

LONG = "password = hunter2hunter2 " + "aZ9" * 40_000 + " end of it"


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, very long, repeated and white texts, null ids, and columns that clash with what operators add."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", 5), (2, None, 5), (3, "", 5), (4, LONG, 5), (5, "the quick brown fox jumps over the lazy dog", 5),
        (5, "the quick brown fox jumps over the lazy dog", 5), (None, "one two", None), (6, " \n\t ", 5), (7, "one two", 5), (8, "ÉÈ 日本語 é́ 🎉\x00\x1c x", None),
    ]
    schema = "doc_id long, text string, n_tokens int"
    return spark.createDataFrame([(*r, *(["x"] * 6)) for r in rows], schema + ", ids string, key string, redacted string, p_toxic string, gone string, leak string").repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
