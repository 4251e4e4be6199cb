"""Filters, paging, first-per-group, top-k, sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Equality filters for those arguments that aren't None."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return top_per(df, keys, order, 1).drop("rank")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(column: str, order: Sequence[str]) -> Column:
    """Place in a list of values; what isn't listed comes last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in the order of md5(key | seed): the same ones at every run."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed))), key).limit(n)


def hash_share(key: Column, modulus: int) -> Column:
    """Whether the first 12 hex digits of sha256(key) are divisible by modulus."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 12), 16, 10).cast("long") % modulus == 0


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """facet, value, n: how often each value of each column occurs."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f"))
    return rows.select("f.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """About n rows, each stratum by the square root of its size and with one at least; the first by md5(key | seed)."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum(F.sqrt("size")).alias("all"))
    quota = sizes.crossJoin(F.broadcast(total)).select(stratum, F.least("size", F.greatest(F.lit(1), F.floor(F.lit(n) * F.sqrt("size") / F.col("all")))).alias("quota"))
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed))), key)
    return df.withColumn("rank", F.row_number().over(w)).join(quota, stratum).where(F.col("rank") <= F.col("quota")).drop("rank", "quota")
