import pytest

AWKWARD = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (2, "one two three four five six seven", "en", "a", 33),
    (3, None, None, None, None),
    (4, "", "fr", "b", 0),
    (5, "x", "fr", "b", 1),
    (6, "  lead  and\n\ntrail \t ", "de", "é", 20),
    (7, "wörd ñandú 𝔘nicode 👍🏽 naïve " * 40, "es", "\U0001f600", 1160),
    (8, "long " * 60_000, "en", "a", 300_000),
    (9, "it's we'll don't  1234 5.6 <|endoftext|> !!!", "en", "a", 40),
    (None, "no id here", "en", "a", 10),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and a column that clashes with names used inside."""
    rows = [(*r, 0, "x") for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, _p string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
