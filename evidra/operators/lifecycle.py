"""Stages of a unit from its events: current stage, entry date, what is missing, stalls, matrices and funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_order(stage: Column, stages: Sequence[str]) -> Column:
    """Ordinal from 1; null for what isn't a stage."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), stage)
    return F.when(place > 0, place.cast("int"))


def with_order(events: DataFrame, stages: Sequence[str], stage: str = "stage") -> DataFrame:
    return events.withColumn("ord", stage_order(F.col(stage), stages))


def lifecycle(units: DataFrame, events: DataFrame, *, unit: str, stage: str, day: str, stages: Sequence[str], exempt: str, as_of: Column, limits: dict[str, int]) -> DataFrame:
    """One row a unit: highest stage ordinal (exemptions don't count), its first date, days in it, the next
    stage, mandatory stages missing below it, exemption conflict, and whether it stalls (days over its limit).

    One grouped pass over the events; a unit without events keeps nulls."""
    rows = with_order(events, stages, stage)
    per_stage = rows.groupBy(unit, stage, "ord").agg(F.min(day).alias("first"), F.count("*").alias("n"))
    folded = per_stage.groupBy(unit).agg(
        F.max("ord").alias("ord"),
        F.max_by("first", "ord").alias("entered"),
        F.bool_or(F.col(stage) == exempt).alias("exempt"),
        F.array_sort(F.collect_set(F.when(F.col("ord").isNotNull(), F.col("ord")))).alias("have"),
        F.sum("n").alias("n_events"),
    )
    names = F.array(*[F.lit(s) for s in stages])
    missing = F.filter(F.transform(F.array_except(F.sequence(F.lit(1), F.greatest("ord", F.lit(1))), F.col("have")), lambda o: F.element_at(names, o)), lambda s: s.isNotNull())
    limit = F.coalesce(*[F.when(F.col("current_stage") == s, d) for s, d in limits.items()])
    days = F.datediff(as_of, F.col("entered")).cast("long")
    out = units.select(unit).join(folded, unit, "left").withColumn("current_stage", F.when(F.col("ord").isNotNull(), F.element_at(names, F.col("ord"))))
    return out.select(
        unit, "current_stage", F.col("ord").cast("int").alias("ord"), "entered", days.alias("days_in_stage"),
        F.when((F.col("ord") < len(stages)) & F.col("ord").isNotNull(), F.element_at(names, F.least(F.col("ord") + 1, F.lit(len(stages))))).alias("next_stage"),
        F.when(F.col("ord").isNotNull(), F.array_join(missing, ",")).alias("missing"),
        (F.coalesce("exempt", F.lit(False)) & F.coalesce(F.col("ord") > 1, F.lit(False))).alias("conflict"),
        F.coalesce(days >= limit, F.lit(False)).alias("stalled"), F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"),
    )


def stage_matrix(lives: DataFrame, group: str) -> DataFrame:
    """group, stage, units in it, of those stalled."""
    return lives.groupBy(group, F.coalesce("current_stage", F.lit("none")).alias("stage")).agg(F.count("*").alias("units"), F.count_if("stalled").alias("stalled"))


def funnel(events: DataFrame, *, unit: str, stage: str, stages: Sequence[str]) -> DataFrame:
    """stage, ord, units with any evidence of it: all stages, also those without."""
    every = events.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(stages)], "ord int, stage string")
    seen = events.groupBy(F.col(stage).alias("stage")).agg(F.countDistinct(unit).alias("units"))
    return every.join(seen, "stage", "left").select("stage", "ord", F.coalesce("units", F.lit(0)).alias("units"))


def stage_at(units: DataFrame, events: DataFrame, *, unit: str, at: str, stage: str, day: str, stages: Sequence[str]) -> DataFrame:
    """The highest stage (latest date on a tie) among the events up to each row's date: an as-of join by one window over both sides."""
    points = units.select(F.col(unit), F.col(at).alias("_at"), F.lit(None).cast("int").alias("ord"), F.lit(1).alias("_point"), *[c for c in units.columns if c not in (unit, at)])
    marks = with_order(events, stages, stage).where("ord is not null").select(unit, F.col(day).alias("_at"), "ord", F.lit(0).alias("_point"))
    upto = Window.partitionBy(unit).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(points, allowMissingColumns=True).withColumn("best", F.max("ord").over(upto))
    names = F.array(*[F.lit(s) for s in stages])
    return both.where("_point = 1").withColumnRenamed("_at", at).withColumn("stage_at", F.when(F.col("best").isNotNull(), F.element_at(names, F.col("best")))).drop("ord", "_point", "best")


def event_list(events: DataFrame, *, unit: str, stage: str, day: str, stages: Sequence[str]) -> DataFrame:
    """unit, events: its events as text in date order, nulls last, then stage order."""
    rows = with_order(events, stages, stage)
    item = F.struct(F.col(day).isNull().alias("late"), F.col(day).alias("day"), F.coalesce("ord", F.lit(99)).alias("ord"), F.col(stage).alias("stage"))
    text = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws("@", x["stage"], F.date_format(x["day"], "yyyy-MM-dd")))
    return rows.groupBy(unit).agg(F.array_join(text, " ").alias("events"))


def parcel_lifecycle(parcels: DataFrame, events: DataFrame, *, stages: Sequence[str], exempt: str, mandatory: Sequence[str], following: dict[str, str], stalls: dict[str, tuple[str, str, float]], thresholds: DataFrame, as_of: Column, block: str = "block_level", level: str = "survey_level", conflict: str = "AWARD") -> DataFrame:
    """Stages of parcels from linked events (parcel_uid, stage, day, link_kind), with what each link is worth.

    current_stage: the highest of all but exemptions; current_stage_evidence and current_stage_parcel_only tell whether a link better than the
    block's shows it. stalls: per stage the flag, the name of its days in thresholds (key, value), and the days where thresholds don't have it."""
    rows = with_order(events, stages).groupBy("parcel_uid", "stage", "ord", "link_kind").agg(F.min("day").alias("day"), F.count("*").alias("n"))
    counts, better = F.col("stage") != exempt, F.col("link_kind") != block
    live = F.when(counts, F.col("ord"))
    folded = rows.groupBy("parcel_uid").agg(
        F.max(live).alias("ord"), F.max(F.when(better, live)).alias("ord_parcel"), F.coalesce(F.bool_or(~counts & better), F.lit(False)).alias("has_exemption"), F.bool_or(F.col("link_kind").isin("parcel", "list_member")).alias("_own"),
        F.bool_or(F.col("link_kind") == level).alias("_level"), F.sum("n").alias("n_events"), F.sum(F.when(~better, F.col("n")).otherwise(0)).alias("n_block_events"), F.collect_set("ord").alias("_have"),
        F.collect_list(F.struct("ord", "day", better.alias("better"))).alias("_all"),
    )
    names = F.array(*[F.lit(s) for s in stages])
    now = F.filter("_all", lambda x: x["ord"] == F.col("ord"))  # at most one a stage and kind of link
    out = parcels.select("parcel_uid").join(folded, "parcel_uid", "left").withColumns({"entered": F.array_min(F.transform(now, lambda x: x["day"])), "_shown": F.exists(now, lambda x: x["better"]), "current_stage": F.when(F.col("ord").isNotNull(), F.element_at(names, F.col("ord")))})
    days = F.datediff(as_of, "entered").cast("long")
    limits = thresholds.agg(*[F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit(default)).cast("double").alias(f"_limit_{s}") for s, (_, k, default) in stalls.items()])
    out = out.join(F.broadcast(limits))  # one row
    stalled = F.coalesce(*[F.when((F.col("current_stage") == s) & (days > F.col(f"_limit_{s}")), F.lit(flag)) for s, (flag, _, _) in stalls.items()], F.lit(None).cast("string"))
    after = F.coalesce(*[F.when(F.col("current_stage") == s, F.lit(n)) for s, n in following.items()], F.when(F.col("ord").isNull(), F.lit(mandatory[0])), F.when(F.col("ord") < stages.index(conflict) + 1, F.lit(conflict)))
    order = [stages.index(m) + 1 for m in mandatory]
    missing = F.array_compact(F.array(*[F.when((F.lit(o) < F.col("ord")) & ~F.array_contains("_have", o), F.lit(m)) for o, m in zip(order, mandatory, strict=True)]))
    exempted = F.coalesce("has_exemption", F.lit(False))
    return out.select(
        "parcel_uid", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), F.coalesce("n_block_events", F.lit(0)).cast("long").alias("n_block_events"), "current_stage", "entered", days.alias("days_in_stage"),
        F.when(F.col("ord").isNotNull(), F.when(F.col("_shown"), "parcel").otherwise(block)).alias("current_stage_evidence"), F.when(F.col("ord_parcel").isNotNull(), F.element_at(names, F.col("ord_parcel"))).alias("current_stage_parcel_only"),
        after.alias("next_expected_stage"), F.array_join(missing, ",").alias("missing_mandatory"), exempted.alias("has_exemption"), (exempted & F.coalesce(F.col("ord") >= stages.index(conflict) + 1, F.lit(False))).alias("exemption_conflict"),
        F.when(F.col("n_events").isNull(), "none").when(F.col("_own"), "parcel").when(F.col("_level"), level).otherwise(block).alias("evidence_level"), stalled.alias("stalled_flag"),
    )
