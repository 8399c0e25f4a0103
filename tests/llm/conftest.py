import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of documents from texts, ids from 0; extra columns clash with results."""

    def make(texts, extra=()):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        for c in extra:
            df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
