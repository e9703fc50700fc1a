import pytest

#: Rows every operator must take: nulls in any column, empty and long texts, repeated rows, clashing extra columns.
ODD = [
    (1, None, None, None, None, 1, "x"),
    (2, "", "en", "src0", 0, None, None),
    (3, "   \n\t ", "en", None, 6, 3, "y"),
    (None, "a text without an id, alone", None, "src1", 5, 4, "z"),
    (5, "the same row " * 9, "en", "src0", 117, 5, "z"),
    (5, "the same row " * 9, "en", "src0", 117, 5, "z"),
    (6, "Ünïcödé — 日本語 текст ß \U0001f600 " * 400, "de", "src0", 12000, 6, "z"),
    (7, "word " * 30000, "en", "src0", 150000, 7, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, _id string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
