import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from (doc_id, text, lang, source) rows, with clashing extra columns."""

    def make(rows):
        full = [(i, t, la, so, None if t is None else len(t), "x", 1) for i, t, la, so in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null in any column, empty, blank, very long, tied and repeated rows."""
    long_text = "alpha beta gamma delta " * 20_000
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, long_text, "en", "b"), (5, "one", None, "b"), (6, "one two", "de", None),
            (6, "one two", "de", None), (None, "one two three four", "en", "a"), (7, "ONE two", "de", "c"), (8, "naïve <|endoftext|> café", "fr", "c")]
