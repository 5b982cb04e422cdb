import pytest
from odd_rows import ODD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = []
        for row in rows:
            doc, text, lang, source = (*row, "en", "src0")[:4] if len(row) == 2 else row
            full.append((doc, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture
def clash(odd_docs):
    """The odd rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["kept", "n_words", "epoch", "bands", "rep", "spans", "_q_lang", "component_id", "place", "node", "digest", "rank"]
    return odd_docs.withColumns({n: F.lit("x") for n in names})
