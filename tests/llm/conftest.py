import pytest

# what may stand in any table: nulls, empty and long texts, ties, repeated rows, names that clash
LONG = "lorem ipsum dolor " * 9000
TEXTS = [
    (0, "The cat sat on the mat, and the dog looked at it.\nA second line that is long enough to be compared here."),
    (1, "The cat sat on the mat, and the dog looked at it.\nA second line that is long enough to be compared here."),
    (2, "the cat sat on the mat, and the dog looked at it\nA second line that is long enough to be comparad here."),
    (3, None), (4, ""), (5, " \n\t "), (6, "Ünï çödé 日本 😀 words"), (7, LONG), (7, LONG), (None, "text without an id"), (None, None),
    (8, "a b"), (9, "x" * 5000), (10, "one   two\n\n\nthree\r\nfour"), (11, "'s it's <|endoftext|> 12345 a b c"),
]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with every odd case, and extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", None, "x", 1, "y", 2.0, "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string, part int, host string, score double, _t string").cache()


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)
