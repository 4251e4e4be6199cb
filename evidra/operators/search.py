"""Full-text ranking, excerpts, duplicates by digest, cosine top-k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


WORD = r"\p{L}\p{N}"


def text_search(docs: DataFrame, terms: Sequence[str], *, key: str, text: str, k: int, all_terms: bool = False) -> DataFrame:
    """key, score, hits of the k best documents with any (or all) of the terms; score: term frequencies over the log of the length.

    Words are counted by their pattern, so no array of a text's words is made."""
    wanted = sorted({t.lower() for t in terms})
    low = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    one = [F.regexp_count("_t", F.lit(rf"(?<![{WORD}])\Q{t}\E(?![{WORD}])")) for t in wanted]
    counted = low.select(key, *[c.alias(f"_{i}") for i, c in enumerate(one)], F.regexp_count("_t", F.lit(f"[{WORD}]+")).alias("_n"))
    names = [F.col(f"_{i}") for i in range(len(wanted))]
    hits = sum(((c > 0).cast("int") for c in names), F.lit(0))
    scored = counted.withColumns({"hits": hits, "score": F.round(sum(names, F.lit(0)) / (1 + F.log(F.col("_n").cast("double") + 1)), 6)})
    kept = scored.where(F.col("hits") >= (len(wanted) if all_terms else 1))
    return kept.orderBy(F.desc("score"), key).limit(k).select(key, "score", "hits")


def excerpt(text: Column, term: str, around: int = 40) -> Column:
    """Some characters around the first place of a term; the beginning without it."""
    at = F.locate(term.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(term)))).otherwise(F.substring(text, 1, 2 * around))


def duplicate_groups(files: DataFrame, digest: str, path: str) -> DataFrame:
    """digest, primary (smallest path), n: groups of equal content."""
    return files.groupBy(digest).agg(F.min(path).alias("primary"), F.count("*").alias("n")).where("n > 1")


def cosine_top_k(vectors: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int, block: int = 1024, chunk: int = 8192) -> DataFrame:
    """query, key, score (6 digits), rank: the k nearest by cosine of a stated query set among all other vectors; ties to the smaller key.

    Blocks of queries meet chunks of vectors as matrices, and each pair of them gives its k best alone. Null and zero vectors take no part."""
    real = F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)
    have, want = vectors.where(real).select(key, vector), queries.where(real).select(key, vector)
    chunks, blocks = (max(1, -(-df.count() // size)) for df, size in ((have, chunk), (want, block)))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = want.select(deal(blocks).alias("_b"), every(chunks).alias("_c"), F.col(key).alias("_q"), F.col(vector).alias("_qv"))
    right = have.select(every(blocks).alias("_b"), deal(chunks).alias("_c"), key, vector)

    def unit(x: pd.Series) -> np.ndarray:
        m = np.array(x.tolist(), float)
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": a["_q"][:0], key: b[key][:0], "score": np.zeros(0)})
        score = unit(a["_qv"]) @ unit(b[vector]).T
        score[a["_q"].to_numpy()[:, None] == b[key].to_numpy()[None]] = -np.inf
        least = np.partition(score, -k, axis=1)[:, -k][:, None] if len(b) > k else np.full((len(a), 1), -2.0)
        i, j = np.nonzero((score >= least - 1e-6) & np.isfinite(score))  # with those that rounding may bring level
        return pd.DataFrame({"query": a["_q"].to_numpy()[i], key: b[key].to_numpy()[j], "score": score[i, j]})

    kind = dict(vectors.dtypes)[key]
    found = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInPandas(best, f"query {kind}, {key} {kind}, score double").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
