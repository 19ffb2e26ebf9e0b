import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("lang", T.StringType()).add("source", T.StringType()).add("n_chars", T.LongType())

#: Null, empty, blank, very long, repeated and odd texts.
ODD = [None, "", "  \n\t ", "a", "A", "word " * 30_000, "x" * 50_000, "Tie tie TIE", "tie tie tie", "Same text here.", "Same text here.", "naïve Ünïcode 漢字 🙂", "\x1c\x85　", "1 2 3"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with nulls in every column, a repeated row, and extra columns named like outputs."""
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD)]
    rows += [(9, "Same text here.", None, None, None), (None, "Same text here.", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
