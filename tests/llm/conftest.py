import pytest


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) rows, with the table's other columns and clashing ones."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, scan string, fp string, size int, _hash string, shard string"
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", 1, "z", "w") for i, t in rows], schema).repartition(3)

    return make


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def prose():
    """``prose(seed, n)``: n words."""
    import random

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))

    return make
