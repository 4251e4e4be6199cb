"""Sequences: runs, gaps, streaks, fill-down, year over year, rolling sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """keys, run, value, first, last, n: stretches of equal neighbouring values (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    numbered = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w).cast("long"))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def longest_gap(df: DataFrame, keys: Sequence[str], day: str, start: Column, end: Column) -> DataFrame:
    """keys, n_days, max_gap: days with a row in [start, end] and the longest stretch between them, the window's ends included."""
    days = df.where(F.col(day).between(start, end)).select(*keys, day).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    gaps = days.withColumn("_g", F.datediff(F.lead(day, 1).over(w), F.col(day)))
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("n_days"),
        F.greatest(F.coalesce(F.max("_g"), F.lit(0)), F.datediff(F.min(day), start), F.datediff(end, F.max(day))).cast("long").alias("max_gap"),
    )


def streaks(df: DataFrame, keys: Sequence[str], day: str, least: int) -> DataFrame:
    """keys, first, last, n: runs of at least so many days in a row."""
    days = df.select(*keys, day).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    island = days.withColumn("_i", F.date_sub(F.col(day), F.row_number().over(w)))
    return island.groupBy(*keys, "_i").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_i")


def fill_down(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The last value that wasn't null, up to and with each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, True).over(w))


def leading_serial(df: DataFrame, keys: Sequence[str], order: str, serial: str) -> DataFrame:
    """keys, n: how far the serial numbers run 1, 2, 3 from the start."""
    w = Window.partitionBy(*keys).orderBy(order)
    right = df.withColumn("_ok", (F.col(serial) == F.row_number().over(w)).cast("int"))
    kept = right.withColumn("_all", F.min(F.coalesce("_ok", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.groupBy(*keys).agg(F.sum("_all").cast("long").alias("n"))


def year_over_year(df: DataFrame, keys: Sequence[str], year: str, value: str, enough: Column | None = None) -> DataFrame:
    """`delta` to the row of the year before, where there is one (and both are sufficient)."""
    enough = F.lit(True) if enough is None else enough
    w = Window.partitionBy(*keys).orderBy(year)
    rows = df.withColumn("_e", enough)
    fit = (F.lag(year).over(w) == F.col(year) - 1) & F.col("_e") & F.lag("_e").over(w)
    return rows.withColumn("delta", F.when(fit, F.col(value) - F.lag(value).over(w))).drop("_e")


def rolling_sum(df: DataFrame, keys: Sequence[str], seconds: Column, value: str, spans: dict[str, int]) -> DataFrame:
    """Sums over the last so many seconds, the row's own included; spans: name and length."""
    rows = df.withColumn("_s", seconds)
    base = Window.partitionBy(*keys).orderBy("_s")
    return rows.withColumns({name: F.sum(value).over(base.rangeBetween(-length, 0)) for name, length in spans.items()}).drop("_s")


def round_robin(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """turn: 0 for the first row of each key, 1 for the second."""
    return df.withColumn("turn", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def tertile(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """tertile 0, 1, 2 by first rank: edges are linear quantiles of the ranks 1..n, upper edges inclusive."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    third = F.when((F.col("_r") - 1) * 3 <= F.col("_n") - 1, 0).when((F.col("_r") - 1) * 3 <= (F.col("_n") - 1) * 2, 1).otherwise(2)
    return rows.withColumn("tertile", third.cast("long")).drop("_r", "_n")
