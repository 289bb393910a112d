import pytest

DOCS = "doc_id long, text string, source string, id long, digest string, size long, key string, shard int"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table, with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, "x", 1, "k", 5) for i, t in rows], DOCS)

    return make
