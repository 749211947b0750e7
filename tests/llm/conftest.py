import pytest

SMALL = "/root/testdata/sf0.001"
LONG = "zz " * 30_000 + "a" * 50_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and very long texts, repeated rows, more columns with clashing names."""
    rows = [(1, None, "en", "s", 0, "x"), (None, "some text here", None, None, None, "x"), (2, "", "en", "s", 0, None), (3, LONG, "en", "s", 1, "x"), (4, "the same row", "en", "s", 1, "x"), (4, "the same row", "en", "s", 1, "x"), (5, " \t\n ", "en", "s", 1, "x"), (6, "naïve 日本語 \U0001f600 ½ Ⅷ İstanbul ſ <|endoftext|> é", "en", "s", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
