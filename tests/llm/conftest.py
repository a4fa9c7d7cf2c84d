import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, letters="abcdefghilmnoprstu"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in every column, empty and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 60)
    return [
        (1, "One two three four five six.", "en", "a", 28),
        (1, "One two three four five six.", "en", "a", 28),
        (2, "one two three FOUR five six.", "en", "a", 28),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (None, "No id here, but words enough to count.", "en", None, 1),
        (None, None, None, "a", None),
        (5, long, "en", "a", len(long)),
        (6, " \t\n\x0b\x0c\r ", "en", "", 7),
        (7, "…!? 123 %%%", None, "é", 5),
        (8, base, "en", "b", len(base)),
        (9, base + " tail", "en", "b", len(base)),
        (10, "x" * 200_000, "en", "b", 200_000),
        (11, "😀 astral \U00020000 text", "en", "b", 3),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture
def clashing(odd):
    """The same rows with columns named like results and working columns."""
    from pyspark.sql import functions as F

    names = "shard slot score row carry copies place set text_md5 fingerprint __place __copy rid spans lang_pred size bin".split()
    return odd.select("*", *[F.lit("mine").alias(n) for n in names])


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
