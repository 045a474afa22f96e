import pytest

LONG = "Alpha beta gamma delta epsilon zeta. " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns whose names clash."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [
        (1, base, "en", "s", 1), (2, base, "en", "s", 1), (2, base, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, base, "en", "s", 1),
        (5, LONG, "en", "s", 1), (6, "   \n\t ", "de", None, 3), (7, "é", "fr", "s", 1), (8, "12 34", "en", "s", 5), (9, base + " eighteen", "en", "s", 1), (10, "x" * 300_000, "en", "s", 1),
    ]
    rows = [(*r, "clash", 7, 0.5) for r in rows]
    return spark.createDataFrame(rows, 'doc_id long, text string, lang string, source string, n_chars long, TEXT string, set int, score double').repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
