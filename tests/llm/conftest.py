import random

import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, n string, key string, fingerprint string, held_out string, f0 string"


def words(rng, n, syllables=("the", "an", "ti", "on", "re", "sh", "ou", "ha")):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, an empty text, ties, repeated rows, a very long text, odd characters."""
    rng = random.Random(4)
    shared = words(rng, 60)
    texts = [(1, shared), (1, shared), (2, shared), (3, None), (4, ""), (None, "A text without an id."), (None, None), (6, "  \t\n "), (7, "... !!! ---"), (8, words(rng, 60_000)), (9, "日本語のテキスト ΣΑΣ İ é é <|endoftext|> \u001c x"), (1, words(rng, 30)), (10, "one"), (11, "one two")]
    return [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z", "k", "f", "h", "0") for i, t in texts]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
