import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty and long texts, repeated rows and ties."""
    long_text = " ".join(f"word{i % 997}é" for i in range(30_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "s", 10), (1, "The quick brown fox jumps over the lazy dog.", "en", "s", 10), (2, None, None, None, None),
        (None, "no id here", "en", "s", 3), (3, "", "fr", "s", 0), (4, " \n\t ", None, "s", 3), (5, long_text, "de", None, 1), (6, long_text, "de", "s", 1), (7, "\x1c\x85 \x00 123 !!! 日本語", "es", "s", 2),
    ]


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    """The hard rows as documents with more columns, some named like those that operators make."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(hard_rows, SCHEMA)
    return docs.withColumns({c: F.lit("other") for c in ("score", "length", "id", "key", "component_id", "_row", "start", "_text", "text_", "a b", "x-y")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
