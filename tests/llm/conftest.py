import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """A table of documents from (id, text) pairs, with room for other columns."""

    def make(*rows, extra="", values=()):
        full = [(i, t, "en", "s", len(t or ""), *values) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS + extra)

    return make
