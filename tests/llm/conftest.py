"""Small tables with awkward rows."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows to documents; columns beyond text may be left out."""

    def make(*texts, ids=None, langs=None, sources=None):
        n = len(texts)
        rows = zip(
            ids or range(n), texts, langs or ["en"] * n, sources or ["a"] * n, [None if t is None else len(t) for t in texts], strict=True
        )
        return spark.createDataFrame([tuple(r) for r in rows], DOCS)

    return make
