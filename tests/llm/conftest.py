import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small(spark):
    """The documents of sf0.01."""
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def rows(small):
    return [(r["doc_id"], r["text"], r["source"]) for r in small.collect()]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    shared = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3
    data = [
        (1, "a b c d e f g h i j k l m n", "en", "s1", 10),
        (1, "a b c d e f g h i j k l m n", "en", "s1", 10),
        (1, "another text under the same id", "en", "s2", 10),
        (2, None, None, None, None),
        (None, "text without an id", "en", "s1", 3),
        (None, None, None, None, None),
        (3, "", "en", "s2", 0),
        (4, " \t\n\r ", "en", None, 5),
        (5, "word " * 30_000, "en", "s1", 150_000),
        (6, shared, "en", "s3", 1),
        (7, shared.upper(), "en", "s3", 1),
        (8, "é ü ñ 日本 token = 'abcdef123' é", "fr", "s4", 1),
        (9, "x", "en", "s4", 1),
        (10, "x", "en", "s4", 1),
    ]
    df = spark.createDataFrame(data, DOCUMENTS)
    from pyspark.sql import functions as F

    extra = ["size", "score", "stats", "node", "n", "sig", "comp", "path", "license", "tie", "copies", "word", "file", "held_out"]
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
