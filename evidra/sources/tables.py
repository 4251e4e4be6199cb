"""Reading tables and writing them with the semantics of keyed stores: upsert, insert-new, sync, change-only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet where it is, else the gzipped CSV beside it (header, types inferred)."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # Spark reports a missing path only when it resolves the read
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.read.csv(path.removesuffix(".parquet") + ".csv.gz", header=True, inferSchema=True)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrites path; the job's committer puts files in place as a whole."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of old, and those of new whose key old doesn't have: the first writer wins."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def replace_where(old: DataFrame, new: DataFrame, drop: Column) -> DataFrame:
    """Old rows without those that drop tells, and all of new."""
    return old.where(~F.coalesce(drop, F.lit(False))).unionByName(new, allowMissingColumns=True)


def sync(old: DataFrame, stage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is still in stage."""
    return old.join(stage.select(*keys).distinct(), list(keys), "left_semi")


def mark_stale(old: DataFrame, current: DataFrame, keys: Sequence[str], verdict: str, status: str = "status") -> DataFrame:
    """Old rows no longer among the current ones: dropped without a verdict, else marked stale."""
    flags = current.select(*keys).distinct().withColumn("_here", F.lit(True))
    joined = old.join(flags, list(keys), "left")
    return joined.where(F.col("_here") | F.col(verdict).isNotNull()).withColumn(status, F.when(F.col("_here"), F.col(status)).otherwise("stale")).drop("_here")


def union_arrays(old: DataFrame, new: DataFrame, key: str, array: str, flag: str) -> DataFrame:
    """One row a key: the distinct union of the arrays, and whether any flag is set."""
    both = old.select(key, array, flag).unionByName(new.select(key, array, flag))
    return both.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(array)))).alias(array), F.bool_or(flag).alias(flag))


def same(a: Column, b: Column, tolerance: float | None = None) -> Column:
    """Null-safe equality; numbers within a tolerance."""
    equal = a.eqNullSafe(b)
    return equal if tolerance is None else equal | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], values: dict[str, float | None]) -> DataFrame:
    """Rows of new that old lacks or holds with other values; values: column and tolerance."""
    before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_here"))
    joined = new.join(before, list(keys), "left")
    equal = reduce(lambda a, b: a & b, [same(F.col(c), F.col(f"_{c}"), t) for c, t in values.items()])
    return joined.where(F.col("_here").isNull() | ~equal).select(*new.columns)


def fill_update(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Old rows with the columns of new where new has a value."""
    joined = old.join(new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), list(keys), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*old.columns)


def errata(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows with `supersedes`: the row before it with the same key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return old.unionByName(new).withColumn("supersedes", F.lag(order).over(w))


def iso_z(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def geojson(df: DataFrame, key: str, x: str, y: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.col(key), F.to_json(feature).alias("feature"))
