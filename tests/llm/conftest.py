import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as documents with a clashing extra column."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id long")

    return make
