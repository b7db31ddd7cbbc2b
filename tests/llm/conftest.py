import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, kept boolean, ranges string, place int, fp string, tag long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns named like the operators' own."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(130))
    line = "a line that many of the documents hold, again and again"
    rows = [
        (1, passage + ". " + " ".join(word() for _ in range(80)), "en", "a", 1),
        (2, "Intro " + passage + " outro é ü", "en", "a", 1),
        (2, "Intro " + passage + " outro é ü", "en", "a", 1),
        (3, None, "en", None, None),
        (4, "", "fr", "b", 0),
        (5, "one", None, "b", 3),
        (6, line + "\n\n" + line + "\nown 6\n", "en", "b", 1),
        (7, "  " + line.upper() + "\t\nown 7", "en", None, 1),
        (8, line + "\r\nown 8", "en", "c", 1),
        (None, line + "\nno id", "en", "c", 1),
        (9, "ab " * 40000 + passage, "en", "c", 1),
        (10, " \t\n\x0b\x0c\r ", "en", "c", 7),
        (11, passage, "en", "d", 1),
        (12, passage, "en", "d", 1),
    ]
    return spark.createDataFrame([(*r, 1, "x", True, "y", 2, "z", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
