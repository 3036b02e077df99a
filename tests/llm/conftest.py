import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Every documents-like table of the edge tests: nulls, empty texts, repeated rows, odd extra columns.
EDGE = [
    (1, "Hello big World", "en", "a", 15, "x", 1),
    (2, None, None, None, None, None, None),
    (None, "hello big world", "en", "a", 15, "y", 2),
    (3, "", "en", "b", 0, "z", 3),
    (4, "HELLO BIG WORLD", "en", "b", 15, "x", 1),
    (4, "HELLO BIG WORLD", "en", "b", 15, "x", 1),
    (5, "ÀÉ " * 3000 + "end", "fr", "c", 9003, "x", 1),
    (6, "1234 5678 \n\t", None, "c", 12, "x", 1),
    (7, "x" * 70000, "de", "c", 70000, "x", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Rows with nulls, empty and long texts, ties, repeats and columns that could clash."""
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long, row string, kept int")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
