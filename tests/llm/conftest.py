import pytest

LONG = " ".join(f"word{i % 997} stone{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, very long, repeated and tied rows, a null id, and columns that clash with names of results."""
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, "  \n\t ", None, 3), (4, LONG, "x", 4), (5, "a b c d e f g h", "y", 5), (5, "a b c d e f g h", "y", 5), (6, "a b c d e f g h", "y", 6), (None, "a b c d e f g h", "y", 7), (7, "Grüße, été 中文 😀 <|endoftext|> x\u00a0y", "z", 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_tokens int")


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}/run"
