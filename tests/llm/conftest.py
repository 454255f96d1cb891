import random

import pytest

VOCABULARY = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ran tel mis pok sud vin gar zel".split()]


@pytest.fixture
def prose():
    """Makes texts of n words; the same for the same seed."""

    def make(n: int, seed: int, line: int = 25) -> str:
        r = random.Random(seed)
        words = [r.choice(VOCABULARY) + (r.choice(["", "s", "ed", "ing"])) for _ in range(n)]
        return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))

    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with nulls in any column, and columns whose names clash with the operators' own."""

    def make(texts, ids=None):
        ids = ids or range(len(texts))
        rows = [(i, t, None, "x", 7, "c", 1.0) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words int, key string, score double")

    return make
