import pytest

from recordflow.llm.common import ready


@pytest.fixture(autouse=True)
def prepared(spark):
    return ready(spark)


@pytest.fixture
def make_docs(spark):
    """documents-like rows from (doc_id, text) pairs, with clashing extra columns if asked for."""

    def make(pairs, **extra):
        names = "".join(f", {n} string" for n in extra)
        rows = [(*p, *extra.values()) for p in pairs]
        return spark.createDataFrame(rows, f"doc_id bigint, text string{names}")

    return make
