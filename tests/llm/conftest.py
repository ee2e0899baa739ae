import pytest


@pytest.fixture
def docs(spark):
    """Rows from (doc_id, text), with columns that clash with names the operators use inside."""

    def make(rows, source="src0"):
        full = [(d, t, "en", source if isinstance(source, str) else source(d), None if t is None else len(t), "kept") for d, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make
