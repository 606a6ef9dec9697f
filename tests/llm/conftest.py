import random

import pytest

WORDS = [a + b for a in ("th", "er", "on", "an", "re", "st", "in", "ed") for b in ("a", "ing", "ion", "est", "ou", "le")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", ".", ","]) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty, wordless and very long texts, ties, repeated rows."""
    draw = random.Random(1)
    long_text = prose(draw, 30_000)
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \t\n ", "en", None, 4),
        (3, "one", "en", "a", 3),
        (4, "é😀ß two", "de", "b", None),
        (5, long_text, "en", "a", len(long_text)),
        (6, long_text, "en", "b", len(long_text)),
        (7, "x" * 50_000, None, "b", 50_000),
        (None, "no id at all here", "en", "a", 17),
        (8, "same id, first text here now", "en", "a", 28),
        (8, "same id, second text here now", "en", "a", 29),
    ]
    return rows + [(9, "a repeated row of five words", "en", "b", 28)] * 3


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, edges):
    """Extra columns named like outputs and like intermediates."""
    from pyspark.sql import functions as F

    names = "size target taken shard slot score predicted kept n_words n_hit id node key bands a b x h rank fingerprint license secrets host text_lang".split()
    return edges.withColumns({n: F.lit("other") for n in names})
