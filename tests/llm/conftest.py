import pytest


@pytest.fixture
def docs(spark):
    """Rows of documents with nulls, empty and white texts, repeats, a very long text and extra columns named as results are."""

    def make(*rows):
        whole = [(i, t, lang, src, None if t is None else len(t), "x", 1.0, True) for i, t, lang, src in rows]
        return spark.createDataFrame(whole, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, kept boolean")

    return make
