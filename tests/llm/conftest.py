from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, sha string, row long, fp long, share long"


def make_texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta", "über", "naïve", "42", "x.", "zeta\n", "«eta»", "日本語", "don't", "\t", "émile"]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(n)]
    out: list[str | None] = [None, "", "", " ", "\n\t \n", "a", "A", "one two", "one two three", "x" * 3000, "  double  spaces   here  ", "emoji 👍🏽 <|endoftext|> end"]
    for i, text in enumerate(base):
        out.append(text)
        if i % 5 == 0:
            out.append(text)
        if i % 7 == 0:
            out.append(text + " more")
    out.append(" ".join(rng.choices(words, k=6000)))
    return out


@pytest.fixture(scope="session")
def mixed(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with the names that operators use inside."""
    texts = make_texts()
    rows = [(i * 3, t, "en", "own", i, i, i) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
