"""Planted cases of ploughing, histograms, pages and overlays, and empty tables."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from evidra.operators import inventory

START, END = date(2020, 10, 1), date(2021, 2, 28)


def ploughed(spark, values, seen):
    """Result of one unit: smoothed values by day from 60 days ahead of the window, observations (day, ndvi, bsi)."""
    windows = spark.createDataFrame([("p", 2020, START, END)], "unit string, y int, start date, end date")
    series = [("p", START - timedelta(days=60) + timedelta(days=i), float(v), True) for i, v in enumerate(values)]
    smooth = spark.createDataFrame(series, "unit string, day date, v double, supported boolean")
    rows = spark.createDataFrame([("p", *x) for x in seen], "unit string, day date, ndvi double, bsi double")
    return inventory.ploughing(windows, smooth, rows, "unit", ["y"]).first()


#: Flat to day 80, then up to 0.7 on day 120: greening begins 12 days on.
RISING = [0.2] * 80 + [0.2 + 0.5 * i / 40 for i in range(41)]
ONSET = START + timedelta(days=32)


def at(days):
    return ONSET - timedelta(days=days)


def test_ploughing(spark):
    got = ploughed(spark, RISING, [(at(100), 0.2, 0.10), (at(80), 0.2, 0.12), (at(60), 0.2, 0.11), (at(30), 0.22, 0.31), (at(25), 0.22, 0.31), (at(20), 0.6, 0.9), (at(5), 0.2, 0.9)])
    assert (got["plough_reason"], got["greenup_onset"], got["plough_nobs"], got["plough_date"]) == ("ok", ONSET, 2, at(30))
    assert got["plough_delta"] == pytest.approx(0.2) and got["plough_signal"] == pytest.approx(0.2 / 0.014826)


@pytest.mark.parametrize(
    ("values", "seen", "reason"),
    [
        ([], [], "no_supported_series"),
        ([0.2] * 120, [], "no_greenup"),
        (RISING, [(at(100), 0.2, 0.1), (at(30), 0.2, 0.3)], "no_baseline_obs"),
        (RISING, [(at(100), 0.2, 0.1), (at(90), 0.2, 0.1), (at(30), 0.6, 0.3)], "no_obs_in_window"),
        (RISING, [], "no_baseline_obs"),
    ],
)
def test_ploughing_reasons(spark, values, seen, reason):
    got = ploughed(spark, values, seen)
    assert got["plough_reason"] == reason and got["plough_signal"] is None


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.29, 1.0, 1.1, -0.1, None)], "v double")
    assert [r["n"] for r in inventory.histogram(rows, "v", [0, 0.1, 0.3, 1]).orderBy("bucket").collect()] == [1, 2, 1]
    assert [r["n"] for r in inventory.histogram(rows.limit(0), "v", [0, 1]).collect()] == [0]


def test_pages_take_the_first_segment(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "document_id int, page_no int")
    documents = spark.createDataFrame([(1, "A", None), (2, "A", "other_scheme")], "document_id int, classified_type string, scheme_relevance string")
    segments = spark.createDataFrame([(1, 2, 1, 2, "B"), (1, 1, 2, 2, None), (1, 3, 1, 1, "C")], "document_id int, seg_no int, page_start int, page_end int, doc_type string")
    got = inventory.select_pages(pages, documents, segments, ["A", "B"], {"B": 1}).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "B", "segment"), (1, 3, "A", "document")]


def test_overlay_of_one_plot(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    plots = spark.createDataFrame([("q", 0.0, 0.0, 10.0, 10.0)], f"plot string, {box}")
    boxes = spark.createDataFrame([(1, -5.0, 0.0, 5.0, 10.0), (2, 5.0, 0.0, 20.0, 4.0)], f"uid int, {box}")
    states = spark.createDataFrame([(1, 2020, "wet"), (2, 2020, "dry"), (2, 2021, "dry")], "uid int, y int, state string")
    got = {(r["y"], r["state"]): (r["share"], r["coverage"]) for r in inventory.overlay_shares(plots, boxes, states, ["y"], 3.0).collect()}
    assert got.keys() == {(2020, "wet"), (2020, "dry"), (2021, "dry")}
    assert got[2020, "wet"] == pytest.approx((0.5, 0.7)) and got[2021, "dry"] == pytest.approx((0.2, 0.7))
