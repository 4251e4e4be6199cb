"""Trapezoids, overlaps, dissolves and pixels against counting small cells and against plain rules."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import polygons as pg

FORM = f"uid int, grp string, rings {pg.RINGS}"


def star(rng, n, cx, cy, r):
    """A concave ring around a place."""
    angles = np.sort(rng.random(n)) * 2 * math.pi
    radii = r * (0.3 + rng.random(n))
    return [(cx + a * math.cos(t), cy + a * math.sin(t)) for t, a in zip(angles, radii, strict=True)]


def holds(rings, x, y):
    inside = np.zeros(len(x), bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def shoelace(rings):
    return abs(sum(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2) * (1 if i == 0 else -1) for i, r in enumerate(rings)))


@pytest.fixture(scope="module")
def shapes():
    """Concave polygons, some with a hole, in three groups around the origin (negative places too)."""
    rng = np.random.default_rng(6)
    out = []
    for i in range(24):
        cx, cy = rng.random(2) * 12 - 6
        rings = [star(rng, 9, cx, cy, 3.0)]
        if i % 3 == 0:
            rings.append([(cx + 0.2 * dx, cy + 0.2 * dy) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
        out.append((i, "abc"[i % 3], rings))
    return out


def table(spark, shapes):
    return spark.createDataFrame([(i, g, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, g, rings in shapes], FORM).repartition(3)


def test_trapezoids_keep_the_area_and_stay_in_their_cell(spark, shapes):
    parts = pg.pieces(table(spark, shapes), "rings", 2.0, ["uid"])
    got = {r["uid"]: r["a"] for r in parts.groupBy("uid").agg(F.sum(pg.area()).alias("a")).collect()}
    for i, _, rings in shapes:
        assert got[i] == pytest.approx(shoelace(rings), rel=1e-9)
    assert parts.where("least(l0, l1) < cy * 2 or greatest(u0, u1) > cy * 2 + 2 or x0 < cx * 2 or x1 > cx * 2 + 2 or u0 < l0 or u1 < l1").count() == 0


def grid(step=0.01):
    at = np.arange(-12, 12, step) + step / 2
    x, y = np.meshgrid(at, at)
    return x.ravel(), y.ravel(), step * step


def test_overlaps_match_fine_cells(spark, shapes):
    x, y, cell = grid(0.02)
    inside = [holds(rings, x, y) for _, _, rings in shapes]
    got = {(r["uid_a"], r["uid_b"]): r["area"] for r in pg.overlaps(pg.pieces(table(spark, shapes), "rings", 4.0, ["uid"]), "uid").collect()}
    for i in range(len(shapes)):
        for j in range(i + 1, len(shapes)):
            assert got.get((i, j), 0.0) == pytest.approx((inside[i] & inside[j]).sum() * cell, abs=0.04)
    finer = {(r["uid_a"], r["uid_b"]): r["area"] for r in pg.overlaps(pg.pieces(table(spark, shapes), "rings", 0.5, ["uid"]), "uid").collect()}
    assert finer.keys() == got.keys() and all(finer[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in got.items())


@pytest.mark.parametrize("most", [40, 256])
def test_dissolved_area(spark, shapes, most):
    """Whole cells, and cells that must be reduced in chunks and parted first; copies cover nothing more."""
    x, y, cell = grid(0.02)
    df = table(spark, [*shapes, *[(100 + i, g, rings) for i, g, rings in shapes[:9]]])
    parts = pg.pieces(df, "rings", 8.0, ["uid", "grp"])
    covered = pg.dissolved(parts, ["grp"], 8.0, most)
    got = {r["grp"]: r["a"] for r in covered.groupBy("grp").agg(F.sum(pg.area()).alias("a")).collect()}
    for g in "abc":
        together = np.any([holds(rings, x, y) for _, h, rings in shapes if h == g], axis=0)
        assert got[g] == pytest.approx(together.sum() * cell, abs=0.05)
    whole = {r["grp"]: (r["n"], r["area_sum"], r["area_union"]) for r in pg.union_areas(parts, ["grp"], "uid", 8.0).collect()}
    assert all(whole[g][2] == pytest.approx(got[g], rel=1e-9) and whole[g][0] == 11 for g in "abc")
    assert whole["a"][1] == pytest.approx(sum(shoelace(r) for i, g, r in [*shapes, *shapes[:9]] if g == "a"), rel=1e-9)


def test_union_of_crossing_bars():
    bars = np.array([[0, 4, 1, 1, 2, 2], [1, 2, 0, 0, 4, 4], [0, 4, 0, 3, 1, 4], [0, 4, 1, 1, 2, 2], [6, 7, 0, 0, 1, 1]], float)
    out = pg.union(bars)
    size = lambda s: ((s[:, 1] - s[:, 0]) * (s[:, 4] - s[:, 2] + s[:, 5] - s[:, 3]) / 2).sum()
    at = (np.arange(0, 8, 0.005) + 0.0025)
    x, y = np.meshgrid(at, at)
    under = lambda s, x, y: ((x > s[0]) & (x < s[1]) & (y > s[2] + (s[3] - s[2]) * (x - s[0]) / (s[1] - s[0])) & (y < s[4] + (s[5] - s[4]) * (x - s[0]) / (s[1] - s[0])))
    assert size(out) == pytest.approx(np.any([under(s, x, y) for s in bars], axis=0).sum() * 0.005**2, abs=0.01)
    assert np.sum([under(s, x, y) for s in out], axis=0).max() == 1


def test_outside_and_coverage(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = lambda x, y, w: ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))
    parcels = spark.createDataFrame([(1, "v", [square(0, 0, 4), square(1, 1, 1)]), (2, "v", [square(8, 0, 2)]), (3, "w", [square(0, 0, 1)]), (4, None, [square(0, 0, 1)])], FORM)
    frames = spark.createDataFrame([("v", [ring((0, 0), (9, 0), (0, 9))])], f"grp string, rings {pg.RINGS}")
    parts = pg.pieces(parcels, "rings", 2.0, ["uid", "grp"])
    got = {r["uid"]: (r["area"], r["outside"], r["outside_pct"]) for r in pg.outside(parts, "uid", pg.pieces(frames, "rings", 2.0, ["grp"]), ["grp"], 0.01).collect()}
    assert got.keys() == {2} and got[2] == pytest.approx((4.0, 3.5, 87.5))
    plots = spark.createDataFrame([(7, "p", [ring((0, 0), (4, 0), (4, 4))])], FORM).withColumnRenamed("uid", "plot")
    states = spark.createDataFrame([(1, 2020, "wet"), (3, 2020, "dry"), (2, 2020, "dry")], "uid int, y int, state string")
    rows = {(r["plot"], r["y"], r["state"]): (r["share"], r["coverage"]) for r in pg.coverage(pg.pieces(plots, "rings", 2.0, ["plot"]), "plot", parts, "uid", states, ["y"]).collect()}
    assert rows.keys() == {(7, 2020, "wet"), (7, 2020, "dry")}
    assert rows[7, 2020, "wet"] == pytest.approx(((8 - 0.5) / 8, min(1.0, (8 - 0.5 + 0.5 + 0.5) / 8))) and rows[7, 2020, "dry"][0] == pytest.approx(0.5 / 8)


def test_odd_polygons(spark):
    nan = float("nan")
    p = lambda *xy: [{"x": x, "y": y} for x, y in xy]
    rows = [(1, "a", None), (2, "a", []), (3, "a", [None, []]), (4, "a", [p((0.0, 0.0), (1.0, 1.0))]), (5, "a", [p((0.0, 0.0), (nan, 2.0), (2.0, 0.0), (None, 1.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0), (0.0, 0.0))]), (None, None, [p((0.0, 0.0), (3.0, 0.0), (3.0, 1.0))])]
    df = spark.createDataFrame(rows, FORM)
    parts = pg.pieces(df, "rings", 1.0, ["uid", "grp"])
    assert {r["uid"]: r["a"] for r in parts.groupBy("uid").agg(F.sum(pg.area()).alias("a")).collect()} == {5: pytest.approx(4.0), None: pytest.approx(1.5)}
    assert {r["grp"]: r["area_union"] for r in pg.union_areas(parts, ["grp"], "uid", 1.0).collect()} == {"a": pytest.approx(4.0), None: pytest.approx(1.5)}
    empty = pg.pieces(df.limit(0), "rings", 1.0, ["uid", "grp"])
    assert empty.count() == 0 and pg.overlaps(empty, "uid").count() == 0 and pg.union_areas(empty, ["grp"], "uid", 1.0).count() == 0
    assert pg.pixels(df.limit(0), "rings", ["uid"]).count() == 0


@pytest.mark.parametrize("supersample", [1, 4])
def test_pixels_are_those_whose_places_lie_inside(spark, shapes, supersample):
    got = {(r["uid"], r["px"], r["py"]): r["hits"] for r in pg.pixels(table(spark, shapes), "rings", ["uid"], 0.5, supersample).collect()}
    step = 0.5 / supersample
    at = np.arange(-24 * supersample, 24 * supersample)
    i, j = (v.ravel() for v in np.meshgrid(at, at))
    want = {}
    for uid, _, rings in shapes:
        inside = holds(rings, (i + 0.5) * step, (j + 0.5) * step)
        for x, y in zip((i[inside] // supersample).tolist(), (j[inside] // supersample).tolist(), strict=True):
            want[uid, x, y] = want.get((uid, x, y), 0) + 1
    assert got == want


def test_zonal_statistics_and_classes(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    df = spark.createDataFrame([(1, "a", [p((0, 0), (2, 0), (2, 2), (0, 2))]), (2, "a", [p((0.1, 0.1), (0.2, 0.1), (0.2, 0.2))]), (3, "a", [p((50, 50), (51, 50), (51, 51))])], FORM)
    raster = spark.createDataFrame([(0, 0, 10.0, 10), (1, 0, 20.0, 40), (0, 1, 60.0, 40), (1, 1, float("nan"), 0), (5, 5, 1.0, 10)], "px long, py long, value double, class int")
    got = {r["uid"]: tuple(r)[1:] for r in pg.zonal(pg.pixels(df, "rings", ["uid"], touched=True), raster, ["uid"], 25).collect()}
    assert got.keys() == {1, 2} and got[1] == pytest.approx((3, 30.0, 60.0, float(np.percentile([10, 20, 60], 90)), 100 / 3)) and got[2] == pytest.approx((1, 10.0, 10.0, 10.0, 0.0))
    fractions = {r["uid"]: r for r in pg.class_fractions(pg.pixels(df, "rings", ["uid"], supersample=2), raster, ["uid"], {10: "tree", 40: "crop"}, 2).collect()}
    assert fractions.keys() == {1}
    r = fractions[1]
    assert (r["n_px"], r["nodata_frac"], r["majority"]) == (4.0, 0.25, "crop") and (r["frac_tree"], r["frac_crop"], r["majority_frac"]) == pytest.approx((1 / 3, 2 / 3, 2 / 3))
