"""Incremental runs: what is new, what it touches, which rows change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_new(found: DataFrame, known: DataFrame, key: str, place: list[str], ok: Column) -> DataFrame:
    """kind of each found row: known (same id), reprocessed (known place under another id), unusable, or new."""
    ids = known.select(key).distinct().withColumn("_id", F.lit(True))
    places = known.select(*place).distinct().withColumn("_place", F.lit(True))
    joined = found.join(ids, key, "left").join(places, place, "left")
    kind = F.when(F.col("_id"), "known").when(F.col("_place"), "reprocessed").when(~ok, "unusable").otherwise("new")
    return joined.withColumn("kind", kind).drop("_id", "_place")


def best_version(found: DataFrame, place: list[str], order: list[Column], key: str) -> DataFrame:
    """One row a place: the highest in order, and the keys of those that lose to it."""
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("k"))
    folded = found.groupBy(*place).agg(F.max(at).alias("b"), F.array_sort(F.collect_list(key)).alias("all"))
    return folded.select(*place, F.col("b.k").alias(key), F.array_remove("all", F.col("b.k")).alias("losers"))


def in_scope(rows: DataFrame, end: str, affected_from: Column, halo_days: int = 60) -> DataFrame:
    """Rows whose window ends no earlier than so many days before the first change."""
    return rows.where(F.col(end) >= F.date_sub(affected_from, halo_days))


def affected(touched: DataFrame, edges: DataFrame, key: str, other: str) -> DataFrame:
    """Touched keys and their neighbours over edges (both ways)."""
    there = edges.select(F.col(key).alias("_a"), F.col(other).alias("_b"))
    both = there.unionByName(there.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    near = touched.select(F.col(key).alias("_a")).join(both, "_a").select(F.col("_b").alias(key))
    return touched.select(key).unionByName(near).distinct()


def missing(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What a cache of results doesn't have yet."""
    return wanted.join(cache.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def coverage(units: DataFrame, periods: DataFrame, seen: DataFrame, unit: str, period: str) -> DataFrame:
    """period and quantiles (10, 50, 90 %) of observations a unit, units without any counted as 0.

    Units are never crossed with periods: zeros are added by their number."""
    n = units.agg(F.count_distinct(unit).alias("units"))
    counts = seen.groupBy(period, unit).agg(F.count("*").alias("n")).groupBy(period, "n").agg(F.count("*").alias("times"))
    have = counts.groupBy(period).agg(F.sum("times").alias("_with"))
    zeros = periods.select(period).distinct().join(have, period, "left").crossJoin(F.broadcast(n)).select(period, F.lit(0).cast("long").alias("n"), (F.col("units") - F.coalesce("_with", F.lit(0))).alias("times")).where("times > 0")
    both = counts.unionByName(zeros)
    return both.groupBy(period).agg(*[F.percentile("n", F.lit(p), F.col("times")).alias(f"p{round(100 * p)}") for p in (0.1, 0.5, 0.9)], F.sum("times").cast("long").alias("units"))
