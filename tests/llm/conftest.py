import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("quality", StringType()), StructField("id", LongType()), StructField("key", StringType())])


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 3000}" for i in range(30_000))
    base = " ".join(f"tok{i}" for i in range(80))
    rows = [
        (1, None, "en", None), (2, "", None, "a"), (3, " \t\n", "en", "a"), (4, long, "en", "a"), (5, long, "en", "a"), (6, base, "de", "b"), (6, base, "de", "b"),
        (7, base + " more", "de", "b"), (None, base, "de", "b"), (8, "Two Words", "en", "a"), (9, "two words", "en", "a"), (10, "x" * 5000, "en", "a"), (11, "é ü 漢字 \U0001f600 it's", "fr", None),
    ]
    return spark.createDataFrame([(*r, "q", 5, "k") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
