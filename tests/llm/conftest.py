import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts (ids from 0 on), or from (id, text) pairs, in a few partitions."""
    def make(texts, lang="en", source="s0", parts=3):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(parts)
    return make


@pytest.fixture(scope="session")
def words():
    """A maker of invented sentences."""
    def make(n, seed):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice(["an", "er", "in", "th", "ou", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    return make
