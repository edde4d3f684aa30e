import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""

    def make(rows, extra=()):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) + tuple(v for _, v in extra) for r in rows]
        schema = DOCS + "".join(f", {c} string" for c, _ in extra)
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def real_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Columns whose names the operators use themselves.
CLASHING = [(c, "mine") for c in ("row_id", "row_no", "text_hash", "_lines", "score", "lang_pred", "pii", "copy", "mix_key", "fp", "_hits", "n_words", "n_removed", "_spans", "component_id", "row_key", "_u", "_n")]
EDGE = [(1, None), (2, ""), (3, " \n\t "), (None, "some text with null id"), (4, "same words here again"), (4, "same words here again"), (5, "x " * 60_000), (6, "é ß 漢字 \U0001f600 end"), (7, "same words here again")]
_ = T
