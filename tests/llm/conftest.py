import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SHARED = "this passage of text is shared by many a document"
LONG = " ".join(f"word{k % 5000} and{k % 7}" for k in range(60_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    base = "the quick brown fox jumps over the lazy dog and then it sleeps for a while in the warm sun of the day"
    rows = [
        (1, base + "\n" + SHARED, "en", "a", 1), (2, base + "\n" + SHARED, "en", "b", 1),
            (3, base + " again\n  " + SHARED.upper() + "\t", "en", None, 1), (3, base + " again\n  " + SHARED.upper() + "\t", "en", None, 1),
        (4, None, "fr", "a", None), (5, "", None, "c", 0), (6, LONG, "de", "a", 1), (7, LONG + " end", "de", "a", 1),
            (8, " \n\t ", "fr", "b", 3), (9, "12 34 !?", None, "b", 3), (10, "one", "es", "c", 3),
        (11, SHARED + "\n" + SHARED + "\nplus", "en", "a", 3), (None, "a text without a number " + SHARED, None, "a", 3),
            (12, " x y z\x1cw", "fr", "b", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
