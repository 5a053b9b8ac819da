import random

import pytest

TEXT = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from (doc_id, text) rows, with extra columns whose names clash with inner ones."""

    def make(rows):
        rows = [(i, t, "x", 1, "y", 2, None) for i, t in rows]
        return spark.createDataFrame(rows, TEXT + ", id string, n long, lang string, size long, rep string").repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    """Words of a made-up language, seeded."""
    rng = random.Random(11)
    stock = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def make(n, seed):
        r = random.Random(seed)
        return [r.choice(stock) for _ in range(n)]

    return make


#: null, empty, white space, no letters, one word, repeated rows.
EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "123 !!"), (5, "word"), (6, "same text here"), (6, "same text here"), (None, "null id text")]


@pytest.fixture(scope="session")
def edges():
    return EDGES
