import random

import pytest

SF = "/root/testdata/sf0.01"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, node long, a int"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 60_000, 5000)
    base = prose(rng, 120)
    rows = [
        (1, base, "en", "a", 3, "x", 7, 1),
        (2, base, "en", "a", 3, "x", 7, 1),
        (2, base, "en", "a", 3, "x", 7, 1),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "", 0, 0),
        (5, " \n\t ", "fr", "b", 4, "", 0, 0),
        (6, long, "de", "a", len(long), "y", 1, 2),
        (7, "one two", "en", "c", 7, "", 0, 0),
        (8, "one two", "en", None, 7, "", 0, 0),
        (None, base + " tail", "en", "a", 9, "z", 2, 2),
        (9, "é" * 50 + " ünï ñ x " + prose(rng, 40), "es", "c", 9, "z", 2, 2),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
