"""Tables read from pages: lines, segments, long facts, checks, review decisions, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.checkpoints import cut


def lines(words: DataFrame, page: list[str], line: list[str], text: str, left: str) -> DataFrame:
    """page, line: the words' text from left to right, the box around them and mean confidence."""
    item = F.array_sort(F.collect_list(F.struct(F.col(left).alias("x"), F.col(text).alias("t"))))
    return words.groupBy(*page, *line).agg(F.array_join(F.transform(item, lambda w: w["t"]), " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg("conf"), 3).alias("conf"))


def pages_of(texts: DataFrame, key: str, text: str, n: str) -> DataFrame:
    """key, page_no, text: split at form feeds, cut or padded to n pages."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\f")
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.col(n) - F.size(parts), F.lit(0)))), F.lit(1), F.greatest(F.col(n), F.lit(1)))
    return texts.select(key, F.posexplode(padded).alias("i", "text")).select(key, (F.col("i") + 1).alias("page_no"), "text")


def long_facts(wide: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, fact, value_num, value_text: one row per field that has a value."""
    kinds = dict(wide.dtypes)
    number = lambda c: F.col(c).cast("double") if kinds[c] != "string" else F.col(c).try_cast("double")
    items = F.array(*[F.struct(F.lit(c).alias("fact"), number(c).alias("value_num"), F.col(c).cast("string").alias("value_text")) for c in fields])
    return wide.select(*keys, F.explode(items).alias("f")).select(*keys, "f.*").where("value_text is not null")


def classify(text: Column, rules: list[tuple[str, float, list[str], list[str]]]) -> Column:
    """struct(label, confidence) of the most confident rule (name, confidence, any of, none of) that fits; the first on a tie."""
    hits = F.array(*[
        F.when((F.coalesce(*[F.when(text.rlike(p), True) for p in any_], F.lit(False))) & ~(F.coalesce(*[F.when(text.rlike(p), True) for p in none], F.lit(False)) if none else F.lit(False)), F.struct((-F.lit(c)).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("label")))
        for i, (n, c, any_, none) in enumerate(rules)
    ])
    best = F.array_min(F.array_compact(hits))
    return F.struct(best["label"].alias("label"), (-best["c"]).alias("confidence"))


def review(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Status and value after a decision: approved keeps it, corrected takes the new value and keeps the old as ai_original, rejected drops it."""
    joined = rows.join(decisions.select(key, "decision", "new_value"), key, "left")
    corrected = F.col("decision") == "corrected"
    return joined.select(
        *[F.when(corrected, F.col("new_value")).when(F.col("decision") == "rejected", None).otherwise(F.col("value")).alias("value") if c == "value" else F.col(c) for c in rows.columns],
        F.coalesce("decision", F.lit("pending")).alias("status"), F.when(corrected, F.col("value")).alias("ai_original"),
    )


def narrative_numbers(text: Column, payload: Column) -> Column:
    """Numbers of a text that its payload doesn't hold."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.cast("double"))
    return F.array_sort(F.array_except(numbers(text), numbers(payload)))


def greedy_pairs(scores: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs, best first: each round takes the pairs that are best for either side and sets both aside, until none is left.

    A null on a side or as the score makes no pair."""
    rest, found = cut(scores.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull() & F.col(group).isNotNull()).dropDuplicates([group, left, right, score])), None
    while True:
        order = [F.desc(score), F.col(left), F.col(right)]
        a = F.row_number().over(Window.partitionBy(group, left).orderBy(*order))
        b = F.row_number().over(Window.partitionBy(group, right).orderBy(*order))
        hit = cut(rest.withColumns({"_a": a, "_b": b}).where("_a = 1 and _b = 1").drop("_a", "_b"))
        found = hit if found is None else found.unionByName(hit)
        rest = cut(rest.join(hit.select(group, left), [group, left], "left_anti").join(hit.select(group, right), [group, right], "left_anti"))
        if rest.limit(1).count() == 0:
            return found
