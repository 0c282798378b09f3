"""Small tables with the cases every operator has to handle."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def filler(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    base = filler(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    half = " ".join([*words[:60], *filler(2, 60).split()])
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, near, "en", "a"), (4, half, "fr", "a"), (5, None, "en", "a"), (6, "", "en", None), (7, "one two", "fr", None),
        (8, "one two", None, "c"), (9, filler(3, 9000), "en", "a"), (9, filler(3, 9000), "en", "a"), (10, "  \n\t ", "en", "b"), (11, base.upper(), "de", "c"),
        (12, filler(4, 300) + " " + base, "en", "b"), (13, "ab " * 400, "en", "d"), (14, "é" * 450 + " ünï", "en", "d"), (15, "the same line of words and more words " * 20, "en", "d"),
        (None, filler(5, 30), "en", "e"),
    ]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
