"""Season states by rule, votes of labellers, annual state, routing of model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Thresholds of the season rule (index units), least share and confidence of overruling votes.
WATER, LOW, GREEN_MEAN, GREEN_MIN, SWING, CROP_MAX, CLEARED_MAX, NEIGHBOURS, DROP, OFF_SEASON_SWING = 0.0, 0.3, 0.38, 0.30, 0.25, 0.45, 0.30, 0.30, -0.15, 0.2
COVER_SHARE, SPLIT_CONFIDENCE = 0.6, 0.6
#: Land cover classes that never change, and the seasons that the cover map saw.
COVER_STATES = {"tree": "perennial_veg", "built": "cleared_or_built", "water": "water", "wetland": "water"}
COVER_SEASONS = ((2020, "summer"), (2021, "kharif"), (2021, "rabi"))
INSUFFICIENT = "insufficient_data"


def season_rule(season: Column, sufficient: Column, high: Column, low: Column, amplitude: Column, dry_mean: Column, wetness: Column, peaks: Column, neighbours: Column, change: Column) -> Column:
    """State of a season from its features. A feature that is null meets no condition; without a maximum there is no state.

    In rabi all that is planted turns green: what does not while its neighbours do is cleared. In the dry seasons a peak needs irrigation."""
    known = F.coalesce(sufficient, F.lit(False)) & high.isNotNull() & ~F.isnan(high.cast("double"))
    n = F.coalesce(peaks, F.lit(0))
    rabi = (
        F.when((high < CLEARED_MAX) & (neighbours >= NEIGHBOURS) & (change <= DROP), "cleared_or_built").when((dry_mean >= GREEN_MEAN) & (amplitude < SWING), "perennial_veg")
        .when((n >= 1) & (amplitude >= SWING), "cropped").otherwise("bare_fallow")
    )
    dry = F.when((n >= 1) & (high >= CROP_MAX) & (amplitude >= OFF_SEASON_SWING), "cropped").when(low >= GREEN_MIN, "perennial_veg").otherwise("bare_fallow")
    return F.when(~known, INSUFFICIENT).when((wetness > WATER) & (high < LOW), "water").when(season == "rabi", rabi).otherwise(dry)


def rule_states(seasons: DataFrame, unit: str, year: str, season: str, state: str, cover: DataFrame | None = None) -> DataFrame:
    """seasons with prior_state and prior_src: two cropped seasons of a year are irrigated_multi; where the cover map (unit, cover,
    share) saw the season and is sure of a class that never changes, it overrules."""
    crops = F.count_if(F.col(state) == "cropped").over(Window.partitionBy(unit, year))
    multi = F.when((F.col(state) == "cropped") & (crops >= 2), "irrigated_multi").otherwise(F.col(state))
    out = seasons.withColumns({"prior_state": multi, "prior_src": F.lit("rules")})
    if cover is None:
        return out
    seen = F.lit(False)
    for y, s in COVER_SEASONS:
        seen = seen | ((F.col(year) == y) & (F.col(season) == s))
    fixed = F.coalesce(*[F.when(F.col("cover") == c, s) for c, s in COVER_STATES.items()])
    use = F.coalesce(seen & fixed.isNotNull() & (F.col("share") >= COVER_SHARE) & (F.col("prior_state") != INSUFFICIENT), F.lit(False))
    joined = out.join(cover.select(unit, "cover", "share"), unit, "left").withColumn("_use", use).withColumn("_fixed", fixed)
    return joined.withColumns({"prior_state": F.when(F.col("_use"), F.col("_fixed")).otherwise(F.col("prior_state")), "prior_src": F.when(F.col("_use"), "cover").otherwise("rules")}).drop("_use", "_fixed", "cover", "share")


def annual_state(seasons: DataFrame, keys: Sequence[str], state: str, p: str, order: str) -> DataFrame:
    """State of a year from its sufficient seasons: two crop seasons, or one irrigated_multi, make irrigated_multi; one crop season
    cropped; else the most frequent (first seen on a tie). p: least of the seasons that decide; n_crop: crop seasons."""
    crop = F.col(state).isin("cropped", "irrigated_multi")
    counts = seasons.groupBy(*keys, state).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min(p).alias("p"))
    enough = F.col(state) != INSUFFICIENT
    folded = counts.groupBy(*keys).agg(
        F.sum(F.when(crop, F.col("n")).otherwise(0)).alias("n_crop"), F.min(F.when(crop, F.col("p"))).alias("p_crop"), F.bool_or(F.col(state) == "irrigated_multi").alias("multi"),
        F.max(F.when(enough, F.struct("n", (-F.col("first")).alias("f"), state, "p"))).alias("m"),
    )
    name = F.when((F.col("n_crop") >= 2) | F.col("multi"), "irrigated_multi").when(F.col("n_crop") == 1, "cropped").otherwise(F.coalesce(f"m.{state}", F.lit(INSUFFICIENT)))
    return folded.select(*keys, name.alias("annual_state"), F.when(F.col("n_crop") > 0, F.col("p_crop")).otherwise(F.col("m.p")).alias("p_state"), F.col("n_crop").cast("long").alias("n_crop"))


def vote(labels: dict[str, Column], confidence: dict[str, Column] | None = None, prior: str = "prior") -> Column:
    """struct(label, agreement) of up to three voters; null and empty labels are no vote.

    Three: 3of3, 2of3, or none. Two: 2of2; if they differ and one is the prior, the other's label at enough confidence
    (split_vlm), else split. One: single. No label but for 3of3, 2of3, 2of2 and split_vlm."""
    sure = confidence or {}
    votes = F.array(*[F.struct(F.when(c != "", c).alias("label"), F.lit(k != prior).alias("seen"), F.coalesce(sure.get(k, F.lit(0.0)), F.lit(0.0)).cast("double").alias("p")) for k, c in labels.items()])
    given = F.filter(votes, lambda v: v["label"].isNotNull())
    names = F.transform(given, lambda v: v["label"])
    most = F.filter(F.array_distinct(names), lambda x: F.size(F.filter(names, lambda y: y == x)) >= 2)
    seen = F.filter(given, lambda v: v["seen"])
    strong = (F.size(seen) == 1) & (F.try_element_at(seen, F.lit(1))["p"] >= SPLIT_CONFIDENCE)
    n, alike = F.size(given), F.size(F.array_distinct(names)) == 1
    outcome = (
        F.when(n == 0, "none").when(n == 1, "single").when((n == 3) & alike, "3of3").when((n == 3) & (F.size(most) == 1), "2of3").when(n == 3, "none")
        .when(alike, "2of2").when(strong, "split_vlm").otherwise("split")
    )
    label = F.when(outcome.isin("3of3", "2of3", "2of2"), F.try_element_at(most, F.lit(1))).when(outcome == "split_vlm", F.try_element_at(seen, F.lit(1))["label"])
    return F.struct(label.alias("label"), outcome.alias("agreement"))


def route(p: Column, rule: Column, student: Column, cap: Column, tau: float = 0.75) -> Column:
    """struct(state, p, source): the model's answer if sure enough after its cap, else the rule's, else undecided."""
    capped = F.least(p, F.coalesce(cap, F.lit(1.0)))
    source = F.when(capped >= tau, "model").when(rule.isNotNull(), "rule").otherwise("undecided")
    return F.struct(F.when(source == "model", student).when(source == "rule", rule).alias("state"), capped.alias("p"), source.alias("source"))


def pool_adjacent(scores: Sequence[float], truths: Sequence[float]) -> list[tuple[float, float]]:
    """Isotonic fit: (upper score, level) of blocks with rising mean truth. For the few points of a calibration table."""
    blocks: list[list[float]] = []
    for s, y in sorted(zip(scores, truths, strict=True)):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, y2, n2 = blocks.pop()
            blocks[-1] = [s2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    return [(s, y / n) for s, y, n in blocks]
