"""What is asked about findings, parcels and seasons: filtered lists, timelines, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of severities, most severe first.
SEVERITIES = ("high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    """0 for the most severe; what isn't a severity comes last."""
    return F.coalesce(*[F.when(severity == s, i) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))


def findings_query(findings: DataFrame, *, category: str | None = None, village: str | None = None, severity: str | None = None, least: float | None = None, open_only: bool = True, limit: int | None = None) -> DataFrame:
    """Findings that meet all conditions given (names without regard to case), by severity, then confidence, then key."""
    rows = findings
    for name, value in (("category", category), ("village", village), ("severity", severity)):
        rows = rows if value is None else rows.where(F.lower(name) == value.lower())
    rows = rows if least is None else rows.where(F.col("confidence") >= least)
    rows = rows.where("status = 'open'") if open_only else rows
    ordered = rows.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "key")
    return ordered if limit is None else ordered.limit(limit)


def finding_summary(findings: DataFrame) -> DataFrame:
    """category, severity, n, parcels, mean confidence of open findings, with a total per category."""
    return findings.where("status = 'open'").rollup("category", "severity").agg(F.count("*").alias("n"), F.count_distinct("parcel_uid").alias("parcels"), F.round(F.avg("confidence"), 4).alias("confidence")).where("category is not null")


def evidence_pack(findings: DataFrame, events: DataFrame, seasons: DataFrame, most: int = 10) -> DataFrame:
    """key, finding, its parcel's latest events and seasons (at most so many of each) as ordered arrays."""

    def latest(rows: DataFrame, order: str, name: str) -> DataFrame:
        w = Window.partitionBy("parcel_uid").orderBy(F.desc(order), *[c for c in rows.columns if c not in ("parcel_uid", order)])
        kept = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
        item = F.struct("_i", *[c for c in rows.columns if c != "parcel_uid"])
        return kept.groupBy("parcel_uid").agg(F.array_sort(F.collect_list(item)).alias(name)).select("parcel_uid", F.transform(name, lambda x: x.dropFields("_i")).alias(name))

    wanted = findings.select("parcel_uid").distinct()
    packs = [latest(rows.join(wanted, "parcel_uid", "left_semi"), order, name) for rows, order, name in ((events, "day", "events"), (seasons, "ag_year", "seasons"))]
    return findings.join(packs[0], "parcel_uid", "left").join(packs[1], "parcel_uid", "left")


def parcel_timeline(events: DataFrame, seasons: DataFrame, findings: DataFrame) -> DataFrame:
    """parcel_uid, day, kind, label, source: acquisition events, season states (at the season's end) and findings of each parcel in one list, with its place."""
    rows = (
        events.select("parcel_uid", "day", F.lit("event").alias("kind"), F.col("stage").alias("label"))
        .unionByName(seasons.select("parcel_uid", F.col("end").alias("day"), F.lit("season").alias("kind"), F.concat_ws(" ", "season", "state").alias("label")))
        .unionByName(findings.select("parcel_uid", F.col("day"), F.lit("finding").alias("kind"), F.col("category").alias("label")))
    )
    w = Window.partitionBy("parcel_uid").orderBy(F.col("day").asc_nulls_last(), "kind", "label")
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def season_table(seasons: DataFrame) -> DataFrame:
    """parcel_uid, ag_year and the state of each season (the surest one if a season has several rows), null where there is none."""
    best = seasons.groupBy("parcel_uid", "ag_year", "season").agg(F.max(F.struct("p", "state")).alias("b"))
    return best.groupBy("parcel_uid", "ag_year").agg(*[F.max(F.when(F.col("season") == s, F.col("b.state"))).alias(s) for s in ("kharif", "rabi", "summer")])


def crop_presence(seasons: DataFrame) -> DataFrame:
    """ag_year, season, parcels, cropped (cropped or irrigated_multi), share (4 digits) among those with a state."""
    known = seasons.where("state <> 'insufficient_data'")
    crop = F.count_if(F.col("state").isin("cropped", "irrigated_multi"))
    return known.groupBy("ag_year", "season").agg(F.count("*").alias("parcels"), crop.alias("cropped"), F.round(crop / F.count("*"), 4).alias("share"))


def satellite_summary(observations: DataFrame, value: str) -> DataFrame:
    """parcel_uid, n, usable, first, last, mean, the day of the highest usable value."""
    good = F.col("usable")
    return observations.groupBy("parcel_uid").agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_usable"), F.min("day").alias("first"), F.max("day").alias("last"), F.round(F.avg(F.when(good, F.col(value))), 6).alias("mean"),
        F.min_by("day", F.when(good, F.struct(-F.col(value), F.col("day")))).alias("best_day"),
    )


def satellite_timeseries(observations: DataFrame, value: str, days: int) -> DataFrame:
    """Usable observations, one a day (their mean), with the mean of the last so many days up to each."""
    daily = observations.where("usable").groupBy("parcel_uid", "day").agg(F.avg(value).alias(value), F.count("*").alias("n"))
    w = Window.partitionBy("parcel_uid").orderBy(F.unix_date("day")).rangeBetween(-days + 1, 0)
    return daily.withColumn("recent", F.avg(value).over(w))


def nearest_in_time(points: DataFrame, marks: DataFrame, key: str, at: str, day: str, most: int) -> DataFrame:
    """points with `found` (day of the nearest mark of the key: of the same day, else within so many days, the earlier on a tie).

    One window in either direction over both sides, so no point meets every mark."""
    both = points.withColumn("_d", F.col(at)).withColumn("_m", F.lit(None).cast("date")).unionByName(marks.select(key, F.col(day).alias("_d"), F.col(day).alias("_m")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_d")
    past, future = F.last("_m", True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first("_m", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    held = both.withColumns({"_p": past, "_f": future}).where("_m is null")
    a, b = F.datediff(at, "_p"), F.datediff("_f", at)
    near = F.when(F.col("_f").isNull() | (a <= b), F.col("_p")).otherwise(F.col("_f"))
    return held.withColumn("found", F.when(F.abs(F.datediff(near, at)) <= most, near)).drop("_d", "_m", "_p", "_f")
