"""Boolean search with ranks by cover density, and headlines of several fragments.

A condition is a word, a phrase (words with blanks between them), or a tuple ("and" | "or", condition, ...) or ("not", condition).
A cover is a stretch of words that meets the condition and holds no shorter one that does; a document's rank is the sum over its covers of
0.1 / (1 + words within the cover that are not of the condition). Parts under "not" decide which documents match and take no part in covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: A place is one number: the word's position above these bits, below them the words before it that are not of the condition.
BITS = 31
STEP = 1 << BITS

Condition = str | tuple


def _phrases(condition: Condition, positive: bool = True) -> list[tuple[tuple[str, ...], bool]]:
    """Every phrase as its words, and whether it stands under an even number of nots."""
    if isinstance(condition, str):
        words = tuple(condition.lower().split())
        if not words:
            raise ValueError("a condition needs words")
        return [(words, positive)]
    head, *rest = condition
    if head not in ("and", "or", "not") or not rest or (head == "not" and len(rest) != 1):
        raise ValueError(f"not a condition: {condition!r}")
    return [p for part in rest for p in _phrases(part, positive != (head == "not"))]


def _fold(condition: Condition, leaf: Callable, both: Callable, either: Callable, negated: Callable):
    """Value of the condition's tree from values of its phrases."""
    if isinstance(condition, str):
        return leaf(tuple(condition.lower().split()))
    head, *rest = condition
    if head == "not":
        return negated(rest[0])
    parts = [_fold(r, leaf, both, either, negated) for r in rest]
    return parts[0] if len(parts) == 1 else both(*parts) if head == "and" else either(*parts)


def _postings(text: Column, words: list[str]) -> Column:
    """array of struct(c place, w word) of those words in a text, in order."""
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    found = F.array_compact(F.transform(every, lambda w, i: F.when(F.lower(w).isin(words), F.struct((i + 1).cast("long").alias("p"), F.lower(w).alias("w")))))
    return F.transform(found, lambda x, n: F.struct((x["p"] * STEP + x["p"] - 1 - n).alias("c"), x["w"].alias("w")))


class _Scan:
    """One pass over a document's postings: the last place of every phrase, and what the covers that end so far come to."""

    def __init__(self, condition: Condition, fragments: int = 0, most: int = 30):
        self.condition, self.fragments, self.most = condition, fragments, most
        self.phrases = list(dict.fromkeys(p for p, _ in _phrases(condition)))
        self.words = sorted({w for p, _ in _phrases(condition) for w in p})

    def _start(self, s: Column, phrase: tuple[str, ...]) -> Column:
        last = s[self._name(phrase, len(phrase))]
        return last if len(phrase) == 1 else F.when(last > 0, last - (len(phrase) - 1) * STEP).otherwise(F.lit(0).cast("long"))

    def _name(self, phrase: tuple[str, ...], n: int) -> str:
        return f"l{self.phrases.index(phrase)}_{n}"

    def _settled(self, s: Column) -> list[Column]:
        """Fields with the cover that ends at the last posting counted in, if there is one."""
        whole = _fold(self.condition, lambda p: self._start(s, p), F.least, F.greatest, lambda _: F.lit(1 << 62).cast("long"))
        begin = F.least(whole, s["e"])
        new = begin > s["b"]
        noise = s["e"].bitwiseAND(STEP - 1) - begin.bitwiseAND(STEP - 1)
        worth = F.when(new, 0.1 / (1 + noise)).otherwise(0.0)
        out = [F.greatest(begin, s["b"]).alias("b"), (s["score"] + worth).alias("score"), (s["covers"] + new.cast("long")).alias("covers")]
        if self.fragments:
            first, last = F.shiftright(begin, BITS), F.shiftright(s["e"], BITS)
            fits = (s["n"] > 0) & (last - s["from"] < self.most)
            out += [
                F.when(new & ~fits, first).otherwise(s["from"]).alias("from"),
                F.when(new, F.when(fits, last).otherwise(F.least(last, first + self.most - 1))).otherwise(s["to"]).alias("to"),
                F.when(new & ~fits, worth).otherwise(s["n"] + worth).alias("n"),
                F.when(new & ~fits, self._closed(s)).otherwise(s["best"]).alias("best"),
            ]
        return out

    def _closed(self, s: Column) -> Column:
        one = F.struct((-s["n"]).alias("n"), s["from"].alias("from"), s["to"].alias("to"))
        return F.when(s["n"] > 0, F.slice(F.array_sort(F.array_append(s["best"], one)), 1, self.fragments)).otherwise(s["best"])

    def over(self, postings: Column) -> Column:
        """struct(matched, score, covers[, best fragments as struct(n, from, to)])."""
        zero = F.lit(0).cast("long")
        start = [zero.alias("b"), F.lit(0.0).alias("score"), zero.alias("covers")]
        if self.fragments:
            start += [zero.alias("from"), zero.alias("to"), F.lit(0.0).alias("n"), F.array().cast("array<struct<n:double,from:long,to:long>>").alias("best")]
        start += [zero.alias("e"), *[zero.alias(self._name(p, n)) for p in self.phrases for n in range(1, len(p) + 1)]]

        def step(s: Column, x: Column) -> Column:
            lasts = []
            for p in self.phrases:
                for n in range(1, len(p) + 1):
                    here = x["w"] == p[n - 1]
                    if n > 1:
                        before = s[self._name(p, n - 1)]
                        here = here & (before > 0) & (x["c"] - before == STEP)
                    lasts.append(F.when(here, x["c"]).otherwise(s[self._name(p, n)]).alias(self._name(p, n)))
            return F.struct(*self._settled(s), x["c"].alias("e"), *lasts)

        def finish(s: Column) -> Column:
            have = lambda p: s[self._name(p, len(p))] > 0
            true = lambda c: _fold(c, have, lambda *a: _all(a), lambda *a: _any(a), lambda part: ~true(part))
            return F.struct(true(self.condition).alias("matched"), *self._settled(s))

        return F.aggregate(postings, F.struct(*start), step, finish)


def _all(parts) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def ranked(docs: DataFrame, condition: Condition, *, key: str, text: str, keep: bool = False) -> DataFrame:
    """key, score (6 digits), covers of every document that meets the condition (keep: with its text).

    One pass over each text in its own row, without a shuffle. Case is ignored; null text is empty; a repeated row is found as often as it stands.
    A document that matches by what it lacks alone has score 0."""
    scan = _Scan(condition)
    found = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), _postings(F.col(text), scan.words).alias("_p")).select("_k", "_t", scan.over(F.col("_p")).alias("_s"))
    out = [F.col("_k").alias(key), F.round("_s.score", 6).alias("score"), F.col("_s.covers").alias("covers")]
    return found.where("_s.matched").select(*out, *([F.col("_t").alias("_text")] if keep else []))


def headline(text: Column, condition: Condition, *, fragments: int = 3, most: int = 30, least: int = 10, marks: tuple[str, str] = ("<b>", "</b>")) -> Column:
    """The stretches of a text whose covers give the most rank (at most `most` words from the first cover to the last; the earlier on a tie), in order, with the words of
    the condition marked and ' ... ' between; each goes on to `least` words. Without covers the text's beginning."""
    scan = _Scan(condition, fragments, most)
    shown = sorted({w for p, positive in _phrases(condition) if positive for w in p})
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{WORD}[^\p{{L}}\p{{N}}]*"), F.lit(0))
    done = scan.over(_postings(text, scan.words))
    best = F.transform(scan._closed(done), lambda f: F.struct(f["from"].alias("from"), f["to"].alias("to")))
    best = F.when(F.size(best) > 0, F.array_sort(best)).otherwise(F.array(F.struct(F.lit(1).cast("long").alias("from"), F.lit(least).cast("long").alias("to"))))

    def marked(piece: Column) -> Column:
        hit = F.lower(F.regexp_extract(piece, WORD, 0)).isin(shown)
        return F.when(hit, F.regexp_replace(piece, f"^({WORD})", f"{marks[0]}$1{marks[1]}")).otherwise(piece)

    def fragment(f: Column) -> Column:
        n = F.greatest(f["to"] - f["from"] + 1, F.lit(least)).cast("int")
        return F.trim(F.array_join(F.transform(F.slice(pieces, f["from"].cast("int"), n), marked), ""))

    return F.array_join(F.transform(best, fragment), " ... ")


def search(docs: DataFrame, condition: Condition, *, key: str, text: str, k: int, **how) -> DataFrame:
    """key, score, covers, headline of the k best documents; ties to the smaller key. Headlines are made for those k alone."""
    best = ranked(docs, condition, key=key, text=text, keep=True).orderBy(F.desc("score"), F.col(key).asc_nulls_last()).limit(k)
    return best.select(key, "score", "covers", headline(F.col("_text"), condition, **how).alias("headline"))
