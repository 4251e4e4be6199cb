"""Queries over tables whose rows are dealt, cut off or repeated otherwise than in the test tables."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from evidra.operators import inventory, match, spatial, timeseries
from evidra.plans.registry import ORACLES, QUERIES
from oracle import rows_of


def held(spark, folder, name: str, **frames) -> None:
    """The query over these tables alone, against its SQL over the same."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t, df in frames.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)).toArrow(), con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(want.schema.names)
    assert got.num_rows > 0 and sorted(got.schema.names) == columns
    assert rows_of(columns, got.to_pydict()) == rows_of(columns, want.to_pydict())


@pytest.mark.parametrize("some", ["doc_id < 198", "doc_id < 56", "doc_id % 7 <> 3"])
def test_records_of_unfinished_groups(spark, sf_dir, tmp_path, some):
    """The last document's group lacks its wrapped row, the row of its extent, or any row."""
    held(spark, tmp_path, "q140_parcel_records", documents=spark.read.parquet(f"{sf_dir}/documents.parquet").where(some))


def test_sums_at_a_limit_in_the_order_of_events(spark, tmp_path):
    """Three costs of 90.00 in all: their sum in doubles is over the limit or not by the order they are added in, not by the order of the rows."""
    cents = [(1000 + 37 * u % 2000, 2000 + 91 * u % 3000) for u in range(400)]
    rows = [(3 * u + i, u, c / 100) for u, (a, b) in enumerate(cents) for i, c in enumerate((a, b, 9000 - a - b))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").withColumn("ts", F.lit("2024-01-05 01:02:03").cast("timestamp_ntz"))
    events.coalesce(1).sortWithinPartitions(F.desc("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    want = dict(con.sql(f"select user_id, over from ({ORACLES['q94_quota_pressure']})").fetchall())
    got = {r["user_id"]: r["over"] for r in QUERIES["q94_quota_pressure"](spark, str(tmp_path)).collect()}
    assert {"day", None} == set(want.values()) and got == want


def joined(df) -> tuple[list, int]:
    """Rows of df, and how many rows its joins made in all."""
    rows, todo, made = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind.endswith("JoinExec"):
            made += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows, made


def test_equal_boxes_meet_as_one(spark, monkeypatch):
    """Three shapes, two of which overlap, of 70 boxes each, in blocks of 9: every pair once, and few rows before the last step."""
    monkeypatch.setattr(spatial, "BLOCK", 9, raising=False)
    shapes = [(0.0, 0.0, 10.0, 10.0), (5.0, -5.0, 70.0, 6.0), (200.0, 0.0, 201.0, 1.0)]
    boxes = [(u, *shapes[u % 3]) for u in range(210)]
    area = {(0, 0): 100.0, (1, 1): 715.0, (2, 2): 1.0, (0, 1): 30.0, (1, 0): 30.0}
    want = sorted((u, v, area[u % 3, v % 3]) for u in range(210) for v in range(u + 1, 210) if (u % 3, v % 3) in area)
    got, made = joined(spatial.box_overlaps(spark.createDataFrame(boxes, "uid long, x0 double, y0 double, x1 double, y1 double"), 64.0))
    assert sorted(map(tuple, got)) == want and 0 < made < len(want) / 10


#: Two places of 40 points, two places of 50 targets, one of them near the first points.
POINTS = [(i, 1.0 + 300 * (i % 2), 2.0) for i in range(80)]
TARGETS = [(i, 4.0 + 900 * (i % 2), 6.0) for i in range(100)]


def placed(spark):
    return spark.createDataFrame(POINTS, "id long, x double, y double"), spark.createDataFrame(TARGETS, "target long, tx double, ty double")


def test_counts_of_equal_points(spark):
    got, made = joined(spatial.within_counts(*placed(spark), 10.0))
    assert sorted(map(tuple, got)) == [(i, 50, 5.0) for i in range(0, 80, 2)] and made < 200


def test_nearest_of_equal_points(spark, monkeypatch):
    pairs, whole = [], spatial.within

    def counted(*args):
        near = whole(*args)
        pairs.append(near.count())
        return near

    monkeypatch.setattr(spatial, "within", counted)
    got = sorted(map(tuple, spatial.nearest(*placed(spark), 10.0).collect()))
    assert [(i, t) for i, t, _ in got] == [(i, 0) for i in range(80)]
    assert [d for *_, d in got[:2]] == pytest.approx([5.0, math.hypot(297, 4)]) and 0 < sum(pairs) < 20


def test_overlay_of_equal_plots(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    plots = spark.createDataFrame([(i, 0.0, 0.0, 10.0, 10.0) for i in range(40)], f"plot long, {box}")
    boxes = spark.createDataFrame([(i, 5.0, 0.0, 6.0, 1.0) for i in range(50)], f"uid long, {box}")
    states = spark.createDataFrame([(i, "wet" if i % 5 else "dry") for i in range(50)], "uid long, state string")
    got, made = joined(inventory.overlay_shares(plots, boxes, states, [], 64.0))
    assert {(r["plot"], r["state"]): (round(r["share"], 9), round(r["coverage"], 9)) for r in got} == {(i, s): (c, 0.5) for i in range(40) for s, c in (("wet", 0.4), ("dry", 0.1))}
    assert len(got) == 80 and made < 400


def test_median_of_a_group_without_its_pairs(spark):
    """Groups of 1 to 5 and of 60 with ties, insufficient and null values, against the pairs."""
    sizes = (1, 2, 3, 4, 5, 60)
    units = [(100 * g + i, g) for g, n in enumerate(sizes) for i in range(n)]
    draw = random.Random(5)
    rows = [(u, y, None if draw.random() < 0.1 else float(draw.randrange(8)), draw.random() < 0.8) for u, _ in [*units, (9999, None)] for y in (2020, 2021, 2022)]
    features = spark.createDataFrame(rows, "unit long, y int, v double, ok boolean")
    groups = spark.createDataFrame(units, "unit long, nation int")
    pairs = groups.join(groups.withColumnRenamed("unit", "other"), "nation").where("unit <> other").select("unit", "other")
    got, made = joined(timeseries.group_median(features, groups, "unit", "nation", ["y"], "v", "ok"))
    want = timeseries.neighbour_median(features, pairs, "unit", ["y"], "v", "ok").select(got[0].__fields__).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and made < 3 * len(rows)


def test_a_survey_of_many_units_is_one_link_until_the_end(spark, monkeypatch):
    """Thirty records of a whole survey of 200 units, and thirty of one code that 20 of them share: every link is there, few candidates are made for it."""
    made, plain = [], match.candidates

    def counted(*args):
        found = plain(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(match, "candidates", counted)
    units = spark.createDataFrame([(1000 + i, "A", f"7/{i % 10}B", None, None, 0.5) for i in range(200)], "uid long, village string, code string, block int, unit int, area double")
    asked = [(i, "A", "7", "3B" if i % 2 else None) for i in range(60)]
    records = spark.createDataFrame(asked, "id long, village string, survey_no string, sub_div string")
    records = records.withColumns({**{c: F.lit(None).cast("int") for c in ("block", "unit")}, "extent": F.lit(None).cast("double"), **{c: F.lit(False) for c in ("from_header", "header_conflict", "scheme_header")}})
    got = {r["id"]: r for r in match.link(records, units).collect()}
    for i in range(60):
        r = got[i]
        if i % 2:
            assert (r["status"], r["links"], [c["uid"] for c in r["candidates"][0]]) == ("ambiguous", [], [1003, 1013, 1023])
        else:
            assert r["status"] == "survey_level" and [tuple(x) for x in r["links"]] == [(1000 + u, "survey_level", 0.85) for u in range(200)]
    assert len(got) == 60 and 0 < sum(made) <= 60 * 3
