import pytest

TEXTS = [None, "", "   ", "a", "same text here", "same text here", "Ünïcode straße 🍛 text", "x" * 70_000, "line one\n\nline two\r\nline three", "word " * 3000, "\x00\x01 control", "THE END!! OF!! IT!!"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", "s", len(t or ""), i * 2, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None, None), (3, "a", "en", "s", 1, 6, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, size string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
