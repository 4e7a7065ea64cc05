import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

PASSAGE = "The quick brown fox jumps over the lazy dog near the old mill by the river. It then runs back to its den under the roots of a large oak. Nobody saw where it went after the rain had begun to fall that night."


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return [
        (1, None, "en", "s", None),
        (2, "", None, None, 0),
        (3, " \t\n ", "en", "s", 3),
        (4, "one", "en", "s", 3),
        (5, PASSAGE, "en", "s", len(PASSAGE)),
        (6, PASSAGE, "en", "s", len(PASSAGE)),
        (6, PASSAGE, "en", "s", len(PASSAGE)),
        (7, long, "en", "t", len(long)),
        (8, "x" * 20_000, "en", "t", 20_000),
        (9, "é ü 漢字 😀 " + PASSAGE, "fr", "t", None),
        (None, "no id at all, but some words in it", "en", "s", 34),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
