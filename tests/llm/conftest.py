import pytest

#: Nulls, empty and blank texts, ties, repeated rows and ids, a column whose name clashes with working names.
PHRASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ODD = [
    (1, PHRASE + " alpha", "en", "x"), (2, "beta " + PHRASE, "en", "x"), (3, None, None, None), (4, "", "de", "y"), (5, " \n\t ", "de", "y"),
    (6, PHRASE + " alpha", "en", "x"), (6, PHRASE + " alpha", "en", "x"), (7, PHRASE + "  alpha ", "en", "x"), (8, "a b", "fr", "z"), (9, "A b", "fr", "z"),
    (10, "wörd " * 4000, "de", "y"), (11, "12 34 !!", None, "y"), (None, PHRASE + " gamma", "en", "x"), (12, PHRASE.upper() + " alpha", "en", "x"), (8, "other text of one id", "fr", "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, _id string").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, _id string")
