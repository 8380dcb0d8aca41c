"""Small document tables with every awkward case."""

import pyarrow as pa
import pytest

EDGE_TEXTS = [
    "The cat sat on the mat.\nThe cat sat on the mat.", "", None, " ", "\n\n", "don't  stop\tnow", "Über naïve Straße 日本語 ß ½",
    "x" * 5000, "a b " * 3000, "word " * 40, "!!! ### $$$ | | |", "<|endoftext|> is text", "\x00 \x85 \xa0 end ",
    "The cat sat on the mat.\nThe cat sat on the mat.", "tab\there\r\nline", "é", "🎉🎉 emoji 🎉",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, repeated rows, clashing extra columns."""
    ids = [*range(len(EDGE_TEXTS)), None, None, 3, 3]
    texts = [*EDGE_TEXTS, "no id", "no id", " ", " "]
    n = len(ids)
    return spark.createDataFrame(pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()),
        "lang": pa.array([None] * n, pa.string()), "source": pa.array(["s"] * n), "n_chars": pa.array([None] * n, pa.int64()),
        "n_tokens": pa.array(["x"] * n), "score": pa.array([1] * n), "start": pa.array([0.5] * n),
    })).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
