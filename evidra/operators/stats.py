"""Robust statistics, shares, modal values and model metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(value: Column | str) -> Column:
    """Exact median (mean of the middle two); null and NaN don't count."""
    value = F.col(value) if isinstance(value, str) else value
    return F.percentile(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(0.5))


def robust_scale(df: DataFrame, keys: Sequence[str], value: str, floor: float = 0.0) -> DataFrame:
    """keys, med, scale, n: median and 1.4826 times the median absolute deviation, floored."""
    middle = df.groupBy(*keys).agg(median(value).alias("med"))
    spread = df.join(middle, list(keys)).groupBy(*keys).agg(F.first("med").alias("med"), (F.lit(1.4826) * median(F.abs(F.col(value) - F.col("med")))).alias("scale"), F.count(value).alias("n"))
    return spread.withColumn("scale", F.greatest("scale", F.lit(floor)))


def robust_z(df: DataFrame, controls: DataFrame, keys: Sequence[str], value: str, floor: float) -> DataFrame:
    """z of each row against the controls of its group; null without controls or scale."""
    stats = robust_scale(controls, keys, value, floor)
    z = F.when(F.col("scale") > 0, (F.col(value) - F.col("med")) / F.col("scale"))
    return df.join(stats.select(*keys, "med", "scale"), list(keys), "left").withColumn("z", z)


def percent_rank_among(df: DataFrame, controls: DataFrame, keys: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Share of the group's controls that are at or below each row's value.

    One window over both sides in value order, so no row meets every control."""
    rows = df.withColumn("_control", F.lit(0)).unionByName(controls.select(*keys, value).withColumn("_control", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    counted = rows.withColumns({"_le": F.sum("_control").over(upto), "_all": F.sum("_control").over(every)})
    return counted.where("_control = 0").withColumn(name, F.when(F.col("_all") > 0, F.col("_le") / F.col("_all"))).drop("_control", "_le", "_all")


def modal(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode", count: str = "n_mode") -> DataFrame:
    """The most frequent value of each group; of several the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col(value)).alias("_v"))).alias("_b")
    return counts.groupBy(*keys).agg(best).select(*keys, (-F.col("_b._v")).alias(name), F.col("_b._n").alias(count))


def dominant(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, dominant ('mixed' on a tie), share of it (3 digits)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    top = counts.withColumns({"_top": F.max("_n").over(w), "_all": F.sum("_n").over(w)}).where("_n = _top")
    return top.groupBy(*keys).agg(F.first("_all").alias("n"), F.when(F.count("*") == 1, F.max(value)).otherwise("mixed").alias("dominant"), F.round(F.first("_top") / F.first("_all"), 3).alias("share"))


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], buckets: int = 4096) -> DataFrame:
    """keys and, by name, the element round(p * (n - 1)) (half to even) of each group's sorted values; null and NaN don't count.

    Values are counted first; a histogram tells the bucket that holds a rank, and only that bucket's values are put in order.
    So no group is gathered or sorted whole."""
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    placed = counts.join(span, list(keys)).withColumn("_b", width)
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    filled = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), F.first("_all").alias("_all")).withColumn("_before", ahead)
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.bround(F.lit(p) * (F.col("_all") - 1), 0).cast("long").alias("rank")) for name, p in shares.items()])
    at = filled.withColumn("_r", F.explode(ranks)).where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_n"))).select(*keys, "_b", "_before", F.col("_r.name").alias("_name"), F.col("_r.rank").alias("_rank"))
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    found = placed.select(*keys, "_b", "_v", "_n").join(at, [*keys, "_b"]).withColumn("_upto", inside).where("_upto > _rank and _upto - _n <= _rank")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in shares])


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1."""
    cells = confusion(df, truth, predicted)
    long = cells.select(F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col(truth) != F.col(predicted), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("tp"), F.when(F.col(truth) != F.col(predicted), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )).alias("x")).select("x.*")
    summed = long.groupBy("class").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rates = summed.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return rates.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration(df: DataFrame, probability: str, truth: str, bins: int = 10) -> DataFrame:
    """bin, n, mean probability, share that is true, of equal-width bins (the last includes 1)."""
    bin_ = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(F.col(truth).cast("double")).alias("accuracy"))


def brier_ece(df: DataFrame, probability: str, truth: str, bins: int = 10) -> DataFrame:
    """brier, ece, n."""
    table = calibration(df, probability, truth, bins).agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))
    brier = df.agg(F.avg(F.pow(F.col(probability) - F.col(truth).cast("double"), F.lit(2))).alias("brier"), F.count("*").alias("n"))
    return brier.crossJoin(F.broadcast(table))
