import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, shard int, ids string, cls string, doc string, label int, key string, `size` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    words = " ".join(f"word{i % 977} of the thing{i % 31}" for i in range(20_000))
    texts = [
        (1, "A plain text of some words, with a few more of them."), (1, "A plain text of some words, with a few more of them."),
        (2, None), (3, ""), (4, " \n "), (5, words), (6, "x" * 30_000), (7, "one"), (8, "!!! ??? ---"), (None, "A text without an id."),
        (None, None), (9, "Größe \x01 naïve 😀 \x02 日本語 a@b.co"), (10, "A plain text of some words, with a few more of them."),
    ]
    rows = [(i, t, "en" if i and i % 2 else None, None, None, 1.0, "s", 3, "i", "c", "d", 0, "k", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (5, 1, 0), (8, 0, 1), (8, 0, 1), (99, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
