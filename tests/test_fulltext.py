"""Boolean search against plain loops over words: every stretch tried, shortest covers kept."""

from __future__ import annotations

import random
import re

import pytest

from evidra.operators import fulltext
from evidra.plans.fulltext import CONDITION
from evidra.plans.registry import QUERIES

WORDS = re.compile(r"[^\W_]+")


def meets(words: list[str], condition, free: bool = False) -> bool:
    """Whether words meet a condition; free: whatever stands under a not does."""
    if isinstance(condition, str):
        want = condition.lower().split()
        return any(words[i : i + len(want)] == want for i in range(len(words)))
    head, *rest = condition
    if head == "not":
        return free or not meets(words, rest[0])
    return (all if head == "and" else any)(meets(words, r, free) for r in rest)


def covers(words: list[str], condition, own: set[str]) -> list[tuple[int, int]]:
    """(first, last) of every stretch from one of the condition's words to another that meets it and holds no shorter one that does."""
    at = [i for i, w in enumerate(words) if w in own]
    good = [(i, j) for x, i in enumerate(at) for j in at[x:] if meets(words[i : j + 1], condition, True)]
    return [(i, j) for i, j in good if not any((a, b) != (i, j) and i <= a and b <= j for a, b in good)]


def own_words(condition) -> set[str]:
    return set(condition.lower().split()) if isinstance(condition, str) else set().union(*map(own_words, condition[1:]))


CASES = [
    "a", "a b", "a a b", ("and", "a", "b"), ("or", "a", "b c"), ("and", "a", ("not", "b")), ("and", ("or", "a", "b"), ("or", "c", "d d")), CONDITION,
    ("or", "a", ("not", "b")), ("not", "a"), ("and", "É", ("not", ("and", "a", "b"))), ("and", ("or", "a"), "a b a"),
]


@pytest.mark.parametrize("condition", CASES, ids=str)
def test_ranks_are_those_of_plain_loops(spark, condition):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "D", "é", "x", "y", "this", "from", "on", "the", "by", "que"]
    texts = [" , ".join(rng.choices(vocabulary, k=rng.randint(0, 25))) for _ in range(150)] + [None, "", "a", "a", "...", "a-b_c", "É a"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "a b", 0)]
    got = {(r["id"], r["score"], r["covers"]) for r in fulltext.ranked(spark.createDataFrame(rows, "id long, body string, score long"), condition, key="id", text="body").collect()}
    own, want = own_words(condition), set()
    for key, text, _ in rows:
        words = [w.lower() for w in WORDS.findall(text or "")]
        if meets(words, condition):
            found = covers(words, condition, own)
            score = sum(0.1 / (1 + sum(w not in own for w in words[i : j + 1])) for i, j in found)
            want.add((key, round(score, 6), len(found)))
    assert {(k, c) for k, _, c in got} == {(k, c) for k, _, c in want}
    assert {(k, c): s for k, s, c in got} == pytest.approx({(k, c): s for k, s, c in want}, abs=2e-6)


def test_very_long_text_and_bad_conditions(spark):
    text = "x " * 300_000 + "a b " * 50_000
    (row,) = fulltext.ranked(spark.createDataFrame([(1, text)], "id long, body string"), ("and", "a", "b"), key="id", text="body").collect()
    assert row["covers"] == 99_999 and row["score"] == pytest.approx(9999.9)
    for bad in ("", "  ", ("xor", "a"), ("and",), ("not", "a", "b")):
        with pytest.raises(ValueError, match="condition"):
            fulltext.ranked(spark.createDataFrame([(1, text)], "id long, body string"), bad, key="id", text="body")
    assert fulltext.search(spark.createDataFrame([], "id long, body string"), "a", key="id", text="body", k=3).collect() == []


def test_headlines(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    text = f"One Tree; {filler} a tree, and a house. {filler} tree tree house! {filler} end"
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "id long, body string")
    made = {r["id"]: r["h"] for r in df.select("id", fulltext.headline(df["body"], ("and", "tree", "house"), fragments=2, most=8, least=4).alias("h")).collect()}
    assert made == {1: "<b>tree</b>, and a <b>house</b>. ... <b>tree</b> <b>house</b>! w0 w1", 2: "", 3: "nothing here"}
    found = fulltext.search(df, ("or", "tree", "house"), key="id", text="body", k=5, fragments=1, most=3, least=3).collect()
    assert [(r["id"], r["covers"], r["headline"]) for r in found] == [(1, 6, "<b>tree</b> <b>tree</b> <b>house</b>!")]


def test_search_takes_the_best_ranks(spark, sf_dir):
    found = QUERIES["q147_boolean_search"](spark, sf_dir).collect()
    ranks = sorted(((r["score"], r["doc_id"]) for r in QUERIES["q146_boolean_ranks"](spark, sf_dir).collect()), key=lambda p: (-p[0], p[1]))
    assert [(r["score"], r["doc_id"]) for r in found] == ranks[:20] and all("<b>" in r["headline"] for r in found)
