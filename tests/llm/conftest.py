import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Make a documents table from (doc_id, text) with columns that clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 0.5, 7, "x", -1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, lang_pred string, start long")

    return make
