import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        extra = "host string, content string, row string, rate double, fp long, component_id string, v string, `a.b` int"
        full = [(i, t, "en", "src0", len(t) if t is not None else None, "h", "c", "r", 0.5, 1, "x", "v", 2) for i, t in rows]
        return spark.createDataFrame(full, f"{DOCUMENTS}, {extra}")

    return make


@pytest.fixture(scope="session")
def prose():
    """Random sentences of made-up words, the same for the same seed."""

    def write(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "me", "so", "ta", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return write


@pytest.fixture
def hard(prose):
    """Null, empty and blank texts, a very long text, one very long word, repeated rows and a null id."""
    long = prose(99, 60_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "x" * 300_000), (6, prose(6, 50)), (6, prose(6, 50)), (6, prose(7, 50)), (None, prose(6, 50)), (None, None)]
