import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, x string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null text, empty, blank, very long, equal texts, repeated rows, null id and source, and columns with names operators use."""
    words = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and more", "en", "a", 1, "n", "x"), (2, None, "en", "a", 0, None, None), (3, "", "en", None, 0, "n", "x"), (4, " \n\t ", "fr", "b", 0, "n", "x"),
        (5, words, "en", "b", 9, "n", "x"), (6, words, "en", "b", 9, "n", "x"), (7, "the quick brown fox jumps over the lazy dog and more", None, None, 1, "n", "x"),
        (1, "the quick brown fox jumps over the lazy dog and more", "en", "a", 1, "n", "x"), (8, "two words", "en", "a", 0, "n", "x"), (None, "naïve café \U0001f600 d'été", "fr", "c", 0, "n", "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
