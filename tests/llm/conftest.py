import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, source]) as a table of documents with a clashing extra column."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), -1) for r in rows]
        return spark.createDataFrame(full, DOCUMENT + ", score long")

    return make


@pytest.fixture(scope="session")
def given(spark):
    """The given tables of a size, as lists of dictionaries."""

    def read(sf, name):
        return [r.asDict() for r in spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet").collect()]

    return read
