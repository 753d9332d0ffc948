import pytest

ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all again", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \n\t ", "fr"),
    (5, "The quick brown fox jumps over the lazy dog and runs away from it all again", "en"),
    (5, "The quick brown fox jumps over the lazy dog and runs away from it all again", "en"),
    (None, "nobody knows this one's number éà", None),
    (7, "word", "en"),
    (8, "two words", "de"),
    (9, "same same same same same same same same", "en"),
    (10, "long " * 30000 + "tail", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(d, t, lang, "n", "w", 1.5) for d, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, key string, n double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
