import pytest

from terrane.session import Workspace

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def llm_ws(spark):
    return Workspace(spark, "llm-test")


@pytest.fixture()
def docs_of(spark):
    """Documents from (id, text) pairs or (id, text, lang, source); over several partitions."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "a")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return make


@pytest.fixture()
def odd_docs(docs_of):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names the operators use."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", None), (None, "one two three four", "en", "a"),
        (None, None, None, None), (4, long_text, "en", "a"), (5, "a" * 30_000, "fr", "b"), (6, "same words here again", "en", "b"),
        (6, "same words here again", "en", "b"), (6, "other words with the same id", "en", "b"), (7, "same words here again", None, "a"),
    ]
    extra = {c: F.lit(1) for c in ("row", "base", "found", "score", "size", "key", "_id", "_key", "_hash", "_text", "target", "fingerprint", "kept", "rank", "host")}
    return docs_of(rows).withColumns(extra)
