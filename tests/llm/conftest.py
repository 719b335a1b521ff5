import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, rank int, kept boolean, n_entities string"


def rows(texts):
    """Documents with extra columns whose names clash with inner ones."""
    return [(i, t, "en", "src0", len(t or ""), 1, "k", 2, True, "x") for i, t in texts]


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}x{r.randrange(9)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows(texts), KIND)


@pytest.fixture(scope="session")
def edge_texts():
    """Null, empty and blank texts, ties, repeated rows, a null id, non-Latin text, a very long text, copies and near copies."""
    base = words(1, 300)
    near = list(base)
    near[150] = "changed"
    other = words(2, 200)
    long_ = " ".join(words(3, 9000))
    return [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one two"), (5, " ".join(base)), (6, " ".join(near)), (7, " ".join(base)), (7, " ".join(base)), (8, " ".join(other)),
            (9, "日本語 テキスト é ñ ß 😀 " * 30), (10, long_), (11, long_ + " end"), (None, "a text without an id " * 5), (12, "aaaa" * 400), (13, "x " * 600), (14, " ".join(other) + "\n" + " ".join(base[:120]))]
