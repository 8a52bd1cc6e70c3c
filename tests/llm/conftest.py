import pytest


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text) pairs with the usual columns, and one with a clashing name."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t or ""), f"extra{k}") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
