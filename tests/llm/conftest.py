import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __n string, score string, fp string, blob string, tokens string, rank string, url string"
#: Nulls in every column, empty and blank texts, a long one, repeated rows, and columns that clash with inner names.
ODD = [
    (1, None, None, None, None, "x", "y", "z", "b", "t", "r", None),
    (2, "", "en", "s", 0, "x", "y", "z", "b", "t", "r", ""),
    (3, " \t\n ", "en", None, 4, None, None, None, None, None, None, "no scheme"),
    (4, "The end of it", "en", "s", 13, "x", "y", "z", "b", "t", "r", "http://A.com"),
    (4, "The end of it", "en", "s", 13, "x", "y", "z", "b", "t", "r", "http://A.com"),
    (None, "without an id", "en", "s", 13, "x", "y", "z", "b", "t", "r", "http://x.net/es/1"),
    (5, "12345 ... !!", "de", "s", 12, "x", "y", "z", "b", "t", "r", "http://x.net/fr/1"),
    (6, "word " * 60_000, "de", "s", 300_000, "x", "y", "z", "b", "t", "r", "http://www.example.com/en/"),
    (7, "x" * 20_000, "de", "s", 20_000, "x", "y", "z", "b", "t", "r", "http://example.com/en/"),
    (8, "é日本\U0001f600 don't  stop\r\n", "fr", "s", 20, "x", "y", "z", "b", "t", "r", "x://y.net:80/es/?q#f"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from tracemill.session import ship

    ship(spark)
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    from tracemill.session import ship

    return ship(spark).read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def without_ids(odd):
    return odd.withColumn("doc_id", F.lit(None).cast("long"))
