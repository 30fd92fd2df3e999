import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def no_tables_left(request):
    """What a test has stored is deleted after it."""
    yield
    if "spark" in request.fixturenames:
        from wirelake.llm import common

        common.release(request.getfixturevalue("spark"))


@pytest.fixture
def documents(spark):
    """documents([(id, text), ...]) with the table's columns."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        if extra:  # names that the operators use inside
            for name in ("t", "id", "n", "score", "node", "comp", "keys", "len", "head", "h", "ids"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make


@pytest.fixture
def prose():
    """prose(seed, words): invented sentences over a fixed vocabulary."""

    def make(seed, words=120):
        r = random.Random(seed)
        vocabulary = ["the", "of", "and", "in", "to"] * 20 + [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "ru") for b in ("lo", "ne", "sti", "va") for c in ("n", "ra", "do", "ting", "s")]
        return " ".join(r.choice(vocabulary) + ("." if i % 12 == 11 else "") for i in range(words))

    return make
