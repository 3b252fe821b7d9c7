"""A local session and small tables for the tests of the corpus operators."""

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(shared)).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Nulls in every column, empty and long texts, ties, repeated rows.
AWKWARD = [
    (1, "one two three four five six seven eight", "en", "s"),
    (2, "ONE two three four five six seven eight", None, None),
    (3, "", "en", "s"),
    (4, None, None, "s"),
    (None, "no id here at all", "en", "s"),
    (5, "   \n\t ", "de", "t"),
    (6, "word", "de", "t"),
    (6, "word", "de", "t"),
    (7, "x" * 50_000, "en", "s"),
    (8, "lorem ipsum dolor " * 3_000, "en", "s"),
    (9, "naïve café 日本語 🙂 don't", "fr", "u"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture()
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
