import pytest
from pyspark.sql import SparkSession

#: Rows that every operator must take: null and empty texts, white space alone, one word, repeats and ties.
EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "A b a B"), (6, "a b a b"), (6, "a b a b"), (7, "x" * 5000), (8, "ünï ßtraße — 日本\n\nzwei  drei"), (9, "")]


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def documents(spark):
    """Makes documents, with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", None if (i or 0) % 5 == 4 else f"src{(i or 0) % 3}", len(t or ""), "extra") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)

    return make
