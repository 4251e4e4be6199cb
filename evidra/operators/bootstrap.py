"""Differences of units from controls by period, with intervals that resample units and controls."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of draws of a Poisson variable of mean one that are at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
ROWS = 256


def weights(hashes: np.ndarray, times: int, seed: int) -> np.ndarray:
    """(rows, times + 1): how often each replicate draws a row, by its hash alone, so that tasks agree and reruns do; the first is 1 throughout.

    A counter per replicate is mixed with the hash (xor-shifts and odd factors), and the uniform number that results is looked up in POISSON."""
    with np.errstate(over="ignore"):
        step = np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        z = hashes.astype(np.int64).view(np.uint64)[:, None] + step[None]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    drawn = np.searchsorted(POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right")
    return np.hstack([np.ones((len(hashes), 1)), drawn])


def period_effects(
    units: DataFrame, controls: DataFrame, *, unit: str, cell: str, season: str, period: str, values: Sequence[str], differences: Sequence[tuple[str, str]] = (),
    times: int = 1000, seed: int = 11, within: bool = False,
) -> DataFrame:
    """metric, effect, estimate, ci_lo, ci_hi, n of every value and period, and of the differences (late, early) of two periods, named late-early.

    The estimate of a period is the mean, over rows of units in it, of value less the controls' mean of the same season; n is the number of those rows (of
    a difference: null). The interval (95 %) is that of `times` replicates, each of which draws units and cells with Poisson weights, so a drawn unit
    brings all its seasons; `within` also draws the seasons within it. Null and NaN values, null units, cells, seasons and periods take no part, nor do seasons
    without controls (in a replicate: without drawn ones). Rows should be one a unit and season; repeated ones count again.

    Tasks send sums by period, season and replicate; nothing else is shuffled, and nothing is gathered on the driver."""
    metrics = list(values)

    def rows(df: DataFrame, key: str, when, side: bool) -> DataFrame:
        known = df.where(F.col(key).isNotNull() & F.col(season).isNotNull() & when.isNotNull())
        inner = [F.xxhash64(F.lit("season"), key, season)] if within else []
        named = [F.col(m).cast("double").alias(f"x{i}") for i, m in enumerate(metrics)]
        # the side is hashed too: a cell and a unit of the same name are drawn apart
        return known.select(F.lit(side).alias("side"), when.cast("string").alias("period"), F.col(season).cast("string").alias("season"), F.xxhash64(F.lit(side), key).alias("h"), *[h.alias("h2") for h in inner], *named)

    both = rows(units, unit, F.col(period), True).unionByName(rows(controls, cell, F.lit(""), False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for whole in frames:
            for frame in (whole.iloc[i : i + ROWS] for i in range(0, len(whole), ROWS)):
                drawn = weights(frame["h"].to_numpy(), times, seed)
                if within:
                    drawn *= weights(frame["h2"].to_numpy(), times, seed + 1)
                group, keys = pd.factorize(pd.MultiIndex.from_frame(frame[["side", "period", "season"]]))
                member = (group[None] == np.arange(len(keys))[:, None]).astype(float)
                for i in range(len(metrics)):
                    x = frame[f"x{i}"].to_numpy(float)
                    good = ~np.isnan(x)
                    parts = np.stack([(member * np.where(good, x, 0)) @ drawn, (member * good) @ drawn])
                    for g, key in enumerate(keys):
                        sums[i, *key] = sums.get((i, *key), 0) + parts[:, g]
        for (i, side, when, at), (total, weight) in sums.items():
            yield pd.DataFrame({"i": [i], "side": [side], "period": [when], "season": [at], "total": [total], "weight": [weight]})

    sent = both.mapInPandas(run, "i int, side boolean, period string, season string, total array<double>, weight array<double>")
    merged = sent.select("i", "side", "period", "season", F.posexplode(F.arrays_zip("total", "weight")).alias("b", "s"))
    merged = merged.groupBy("i", "side", "period", "season", "b").agg(F.sum("s.total").alias("total"), F.sum("s.weight").alias("weight"))
    ours, base = merged.where("side"), merged.where(~F.col("side") & (F.col("weight") > 0)).select("i", "season", "b", (F.col("total") / F.col("weight")).alias("mean"))
    joined = ours.join(base, ["i", "season", "b"]).groupBy("i", "b", "period").agg(F.sum(F.col("total") - F.col("weight") * F.col("mean")).alias("d"), F.sum("weight").alias("w"))
    single = joined.where("w > 0").select("i", "b", F.col("period").alias("effect"), (F.col("d") / F.col("w")).alias("v"), F.col("w").alias("n"))
    # one row a metric and replicate holds its few periods, so that differences need no second pass
    wide = single.groupBy("i", "b").agg(F.collect_list(F.struct("effect", "v", "n")).alias("all")).withColumn("of", F.map_from_entries(F.transform("all", lambda e: F.struct(e["effect"], e["v"]))))
    gaps = [F.struct(F.lit(f"{late}-{early}").alias("effect"), (F.try_element_at("of", F.lit(late)) - F.try_element_at("of", F.lit(early))).alias("v"), F.lit(None).cast("double").alias("n")) for late, early in differences]
    effects = wide.select("i", "b", F.inline(F.concat("all", F.array(*gaps)) if gaps else F.col("all"))).where("v is not null")
    drawn = F.when(F.col("b") > 0, F.col("v"))
    out = effects.groupBy("i", "effect").agg(
        F.max(F.when(F.col("b") == 0, F.col("v"))).alias("estimate"), F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.max(F.when(F.col("b") == 0, F.col("n"))).cast("long").alias("n"),
    )
    name = F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("i") + 1)
    return out.select(name.alias("metric"), "effect", "estimate", F.get("ci", F.lit(0)).alias("ci_lo"), F.get("ci", F.lit(1)).alias("ci_hi"), "n")
