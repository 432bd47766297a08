import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A maker of documents: rows of (doc_id, text), or (doc_id, text, lang, source)."""

    def make(*rows):
        full = [(*r, *("en", "src0")[len(r) - 2 :])[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use themselves."""
    return lambda df: df.withColumns({c: F.lit(c) for c in ("id", "count", "score", "text_sha256", "key", "n", "kept")})
