"""Inventories of scenes and pages, shares by area, and signs of ploughing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import with_cells


def month_table(df: DataFrame, day: str) -> DataFrame:
    """year, m1 to m12: rows of each month; a year without rows has no line."""
    months = [F.count_if(F.month(day) == m).alias(f"m{m}") for m in range(1, 13)]
    return df.where(F.col(day).isNotNull()).groupBy(F.year(day).alias("year")).agg(*months)


def bucket(value: Column, edges: Sequence[float], closed: bool = False) -> Column:
    """Number of the bucket [edge, next edge) that holds a value, from 0; null outside. closed: the last edge belongs to the last bucket."""
    inside = F.when(value < edges[0], None)
    for i, edge in enumerate(edges[1:]):
        inside = inside.when(value < edge, i)
    return inside.when(value == edges[-1], len(edges) - 2) if closed else inside


def histogram(df: DataFrame, value: str, edges: Sequence[float], closed: bool = True) -> DataFrame:
    """bucket, low, high, n of every bucket, empty ones too; values outside and nulls count nowhere."""
    n = [F.count_if(bucket(F.col(value), edges, closed) == i) for i in range(len(edges) - 1)]
    line = [F.struct(F.lit(i).alias("bucket"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), c.alias("n")) for i, (a, b, c) in enumerate(zip(edges[:-1], edges[1:], n, strict=True))]
    return df.agg(F.array(*line).alias("all")).select(F.inline("all"))


def class_shares(df: DataFrame, shares: Mapping[str, Column], area: str) -> DataFrame:
    """class, share: sum of share times area over the whole area (a missing share is 0), four digits; classes of no share are left out."""
    whole = F.sum(area)
    line = [F.struct(F.lit(name).alias("class"), F.round(F.sum(F.coalesce(c, F.lit(0.0)) * F.col(area)) / whole, 4).alias("share")) for name, c in shares.items()]
    return df.agg(F.array(*line).alias("all")).select(F.inline("all")).where("share > 0")


def select_pages(pages: DataFrame, documents: DataFrame, segments: DataFrame, types: Sequence[str], most: Mapping[str, int]) -> DataFrame:
    """document_id, page_no, type, type_source of the pages of the wanted types.

    A page has the type of the first segment (by seg_no) with a type that holds it, else its document's.
    documents: document_id, classified_type, scheme_relevance; those of another scheme go. most: last page number by type."""
    known = segments.where("doc_type is not null")
    held = pages.join(known, "document_id").where("page_no between page_start and page_end")
    first = held.groupBy("document_id", "page_no").agg(F.min_by("doc_type", "seg_no").alias("seg_type"))
    own = documents.where("coalesce(scheme_relevance, 'unknown') <> 'other_scheme'").select("document_id", "classified_type")
    rows = pages.join(own, "document_id").join(first, ["document_id", "page_no"], "left").withColumn("type", F.coalesce("seg_type", "classified_type"))
    last = F.lit(None).cast("int")
    for name, n in most.items():
        last = F.when(F.col("type") == name, n).otherwise(last)
    source = F.when(F.col("seg_type").isNotNull(), "segment").otherwise("document")
    return rows.where(F.col("type").isin(*types) & (last.isNull() | (F.col("page_no") <= last))).select("document_id", "page_no", "type", source.alias("type_source"))


def overlay_shares(plots: DataFrame, boxes: DataFrame, states: DataFrame, by: Sequence[str], size: float) -> DataFrame:
    """plot, by, state, share, coverage: parts of each plot's area under a state, and under any box (1 at most).

    plots: plot, x0, y0, x1, y1; boxes: uid and the same; states: uid, by, state. Plots and boxes meet by grid cells of `size`;
    equal plots and equal boxes meet once, with the number of boxes under each state."""
    corners = ("x0", "y0", "x1", "y1")
    figures = plots.where("plot is not null").groupBy("plot").agg(F.array_sort(F.collect_list(F.struct(*corners))).alias("places"))
    each = figures.select("places").distinct().select("places", F.explode("places").alias("_p")).select("places", "_p.*")
    a = with_cells(each, size).withColumnsRenamed({c: f"{c}_a" for c in corners})
    named = boxes.where("uid is not null")
    left, low = F.greatest("x0", "x0_a"), F.greatest("y0", "y0_a")
    width, height = F.least("x1", "x1_a") - left, F.least("y1", "y1_a") - low
    first = (F.floor(left / size) == F.col("cx")) & (F.floor(low / size) == F.col("cy"))
    part = (width * height / ((F.col("x1_a") - F.col("x0_a")) * (F.col("y1_a") - F.col("y0_a")))).alias("part")
    met = a.join(with_cells(named.groupBy(*corners).agg(F.count("*").alias("n")), size), ["cx", "cy"]).where(first & (width > 0) & (height > 0)).select("places", *corners, part, "n")
    coverage = met.groupBy("places").agg(F.least(F.lit(1.0), F.sum(F.col("part") * F.col("n"))).alias("coverage"))
    kinds = named.join(states, "uid").groupBy(*corners, *by, "state").agg(F.count("*").alias("m"))
    shares = met.join(kinds, list(corners)).groupBy("places", *by, "state").agg(F.sum(F.col("part") * F.col("m")).alias("share")).join(coverage, "places")
    return figures.join(shares, "places").select("plot", *by, "state", "share", "coverage")


#: Share of the rise at which greening up begins, days before the window that are looked at, and the spans before that.
RISE, AHEAD, ONSET_FROM, BASE_FROM, BASE_TO, LAST, NOISE, FLAT = 0.3, 60, 30, 120, 42, 14, 0.01, 0.05


def ploughing(windows: DataFrame, smooth: DataFrame, seen: DataFrame, unit: str, keys: Sequence[str], rise: float = 0.15) -> DataFrame:
    """unit, keys, greenup_onset, plough_nobs, plough_signal, plough_date, plough_delta, plough_reason of every window.

    windows: unit, keys, start, end; smooth: unit, day, v, supported; seen: unit, day, ndvi, bsi. Greening up begins where the
    smoothed series, on its way to the window's peak, has three tenths of the rise from its lowest value before. Bare soil of the
    six weeks to two weeks before that (ndvi near the lowest value) is measured against the eleven weeks before them: median
    and spread. Rows without bsi count as seen but have no signal. The largest signal wins, the earlier day on a tie."""
    every = [unit, *keys]
    w = Window.partitionBy(*every)
    day = F.col("day")
    series = windows.join(smooth, unit).where(day.between(F.date_sub("start", AHEAD), F.col("end")))
    series = series.withColumn("top", F.min(F.when(F.col("supported") & (day >= F.col("start")), F.struct((-F.col("v")).alias("less"), "day"))).over(w))
    series = series.where(day <= F.col("top.day")).withColumns({"peak": -F.col("top.less"), "base": F.min("v").over(w)})
    starts = (day >= F.date_sub("start", ONSET_FROM)) & (F.col("v") >= F.col("base") + RISE * (F.col("peak") - F.col("base")))
    green = series.groupBy(*every).agg(F.max("peak").alias("peak"), F.min("base").alias("base"), F.min(F.when(starts, day)).alias("onset"))
    rose = windows.join(green, every, "left").withColumn("rose", F.col("peak") - F.col("base") >= rise).withColumn("onset", F.when(F.col("rose"), F.col("onset")))

    near = rose.where("onset is not null").select(*every, "onset", "base").join(seen, unit).where(day.between(F.date_sub("onset", BASE_FROM), F.date_sub("onset", LAST)))
    before = (day < F.date_sub("onset", BASE_TO)) & F.col("bsi").isNotNull()
    bare = (day >= F.date_sub("onset", BASE_TO)) & (F.col("ndvi") <= F.col("base") + FLAT)
    near = near.withColumns({"before": before, "bare": bare}).withColumn("mid", F.median(F.when(F.col("before"), F.col("bsi"))).over(w))
    best = F.min(F.when(F.col("bare") & F.col("bsi").isNotNull(), F.struct((-F.col("bsi")).alias("less"), "day")))
    found = near.groupBy(*every).agg(
        F.max("mid").alias("mid"), F.median(F.when(F.col("before"), F.abs(F.col("bsi") - F.col("mid")))).alias("mad"), F.count_if("before").alias("n_base"), F.count_if("bare").alias("n_bare"), best.alias("best")
    )
    rows = rose.join(found, every, "left")
    reason = (
        F.when(F.col("peak").isNull(), "no_supported_series").when(~F.col("rose"), "no_greenup").when(F.col("onset").isNull(), "no_onset")
        .when(F.coalesce("n_base", F.lit(0)) < 2, "no_baseline_obs").when(F.col("n_bare") == 0, "no_obs_in_window").otherwise("ok")
    )
    fits = F.col("plough_reason") == "ok"
    delta = -F.col("best.less") - F.col("mid")
    return rows.withColumn("plough_reason", reason).select(
        *every, F.col("onset").alias("greenup_onset"), F.coalesce("n_bare", F.lit(0)).alias("plough_nobs"), F.when(fits, delta / F.greatest(1.4826 * F.col("mad"), F.lit(NOISE))).alias("plough_signal"),
        F.when(fits, F.col("best.day")).alias("plough_date"), F.when(fits, delta).alias("plough_delta"), "plough_reason",
    )
