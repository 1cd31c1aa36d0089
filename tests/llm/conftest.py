import pytest


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text) pairs, with columns whose names clash with ones used inside."""

    def make(rows, **more):
        full = [(i, t, more.get("lang", "en"), more.get("source", "s"), None, 7, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, id string")

    return make
