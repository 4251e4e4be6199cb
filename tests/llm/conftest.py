from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, pattern string, node string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, blanks, copies, ties, a very long text and columns whose names the operators use themselves."""
    long_ = " ".join(f"word{i % 977} of{i}" for i in range(40_000))
    a = "the quick brown fox jumps over the lazy dog near the river bank while the sun is going down behind the old hills"
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s2"), (2, a, "en", "s2"), (3, a + " again", "en", None), (4, None, None, "s1"), (5, "", "en", "s1"),
        (6, "   \t\n", "de", "s3"), (7, "123 456 !!", None, "s1"), (8, long_, "en", "s1"), (None, "null id here with a few more words", "en", "s2"), (None, None, None, None),
        (9, "der schnelle braune fuchs springt ueber den faulen hund am ufer des flusses", "de", "s3"), (10, "le renard brun saute par dessus le chien paresseux près de la rivière", "fr", "s3"),
        (11, "mail a.b+c@ex-ample.co.uk or 10.0.0.255 or 999.1.1.1, card 4111 1111 1111 1111, call +49 (170) 123-45-67.", "en", "s1"), (12, "<|endoftext|>x<|endoftext|>", "en", "s2"), (13, "é" * 300, "fr", "s3"),
    ]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 0.5, "p", "n") for i, t, l, s in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
