import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents out of (id, text) or (id, text, source) rows."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(r[0], r[1], lang, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOC)

    return make
