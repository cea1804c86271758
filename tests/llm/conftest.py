import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text) pairs, with columns that clash with results."""

    def make(pairs):
        return spark.createDataFrame(
            [(i, t, "en", "src0", None if t is None else len(t), "clash", "clash") for i, t in pairs],
            "doc_id long, text string, lang string, source string, n_chars long, kept string, keep string",
        )

    return make


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\n"),
    (4, "one"),
    (None, "a row without an id, as long as any other line\nsecond"),
    (5, "the same row twice, the same row twice, the same row twice"),
    (5, "the same row twice, the same row twice, the same row twice"),
    (6, "very long " * 20000),
    (7, "x" * 30000),
    (8, "café İstanbul ΣΣ \U0001f600\n" * 3),
]


@pytest.fixture(scope="session")
def awkward(make_docs):
    return make_docs(AWKWARD)
