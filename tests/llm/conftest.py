import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, bucket int"


@pytest.fixture
def documents(spark):
    """A function from (doc_id, text[, lang, source]) rows to a table with columns that clash with results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 9.0, 9, 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
