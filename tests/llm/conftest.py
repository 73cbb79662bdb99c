import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those the operators use."""

    def make(texts, ids=None, parts=3):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", 0 if t is None else len(t), 0.5, 7, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and unusual texts."""
    rng = random.Random(5)
    alphabet = "ab'sStrvelmd \n\t  .,!?0123é'ñÉ“½² _  中İΣß́͸\0"
    fuzz = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(150)]
    return [None, "", " \n\t ", "a", "'s's''ll\n's 's", "<|endoftext|> b", "word " * 30_000, "x" * 50_000, " " * 5000 + "y",
            "same text here", "same text here", *fuzz]
