import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, block long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    long_text = " ".join(f"word{i % 977} and" for i in range(6000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog.", "en"),
        (2, "The quick brown fox jumps over the lazy dog.", "en"),
        (2, "The quick brown fox jumps over the lazy dog.", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, "   \n\t ", None),
        (None, "no id here at all", "en"),
        (6, long_text, "en"),
        (7, "x" * 50_000, "en"),
        (8, "12345 !!! ---", None),
        (9, "ÀÉÎ ﬁne Σίσυφος İstanbul 日本語 ́a", "fr"),
        (10, "le la les de des une et que qui", "fr"),
    ]
    return spark.createDataFrame([(i, t, lang, None, None, 0.5, 1, 7) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (6, 0, 0), (10, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
