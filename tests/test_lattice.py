"""Lattice cells against loops over all cells and boxes; samples against their shares."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evidra.operators import lattice

BOX = "x0 double, y0 double, x1 double, y1 double"


def gap(ax, ay, bx, by, box):
    return math.hypot(max(0.0, box[0] - bx, ax - box[2]), max(0.0, box[1] - by, ay - box[3]))


def test_ring_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(4)
    boxes = [tuple(map(float, (x, y, x + w, y + h))) for x, y, w, h in zip(rng.uniform(-900, 900, 40), rng.uniform(-900, 900, 40), rng.uniform(0, 200, 40), rng.choice([0.0, 60.0], 40), strict=True)]
    size, inner, outer = 50.0, 120.0, 330.0
    want = {}
    for ix in range(-30, 32):
        for iy in range(-30, 32):
            x, y = ix * size, iy * size
            corners = [min(gap(cx, cy, cx, cy, b) for b in boxes) for cx in (x, x + size) for cy in (y, y + size)]
            if min(gap(x, y, x + size, y + size, b) for b in boxes) >= inner and max(corners) <= outer:
                want[ix, iy] = min(gap(x + size / 2, y + size / 2, x + size / 2, y + size / 2, b) for b in boxes)
    rows = [*boxes, boxes[0], (None, 1.0, 2.0, 3.0), (5.0, 5.0, 4.0, 9.0)]
    monkeypatch.setattr(lattice, "PART", 7)
    got = {(r["ix"], r["iy"]): r["distance"] for r in lattice.ring_cells(spark.createDataFrame(rows, BOX), size, inner, outer).collect()}
    assert got.keys() == want.keys() and len(want) > 100 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    cells = spark.createDataFrame(list(want), "ix long, iy long")
    dry = lattice.without(cells, spark.createDataFrame(boxes[:3], BOX), size, 200.0)
    assert {tuple(r) for r in dry.collect()} == {k for k in want if min(gap(k[0] * size, k[1] * size, k[0] * size + size, k[1] * size + size, b) for b in boxes[:3]) > 200.0}
    none = spark.createDataFrame([], BOX)
    assert lattice.ring_cells(none, size, inner, outer).count() == 0 and lattice.without(cells, none, size, 9.0).count() == len(want)
    assert lattice.in_sectors(cells, none, size).count() == len(want)


def test_sectors_and_frames(spark):
    ways = [(0, 1, "N"), (1, 1, "NE"), (1, 0, "E"), (1, -1, "SE"), (0, -1, "S"), (-1, -1, "SW"), (-1, 0, "W"), (-1, 1, "NW"), (-0.01, 1, "N"), (0, 0, "N"), (0.4, 1, "N"), (0.42, 1, "NE")]
    got = spark.createDataFrame([(float(a), float(b), s) for a, b, s in ways], "dx double, dy double, s string").select("s", lattice.sector(F.col("dx"), F.col("dy")).alias("g")).collect()
    assert all(r["s"] == r["g"] for r in got)
    frame = spark.createDataFrame([(1.0, -61.0, 119.0, 60.0)], "a double, b double, c double, d double").select(
        lattice.snapped_frame(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 10, 60).alias("s"), lattice.plain_frame(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 8.0).alias("p")
    ).first()
    assert tuple(frame["s"]) == (0, -120, 120, 60, 12, 18) and tuple(frame["p"]) == (1.0, 60.0, 15, 15)


def test_shares_thinning_and_draw(spark):
    cells = spark.createDataFrame([(i, j) for i in range(-20, 20) for j in range(-20, 20)], "ix long, iy long")
    pixels = spark.createDataFrame([(-5.0, -5.0, "a"), (-95.0, -5.0, "b"), (-15.0, -15.0, "a"), (-15.0, -16.0, None), (None, 1.0, "a"), (100.0, 0.0, "a")], "x double, y double, class string")
    got = {(r["ix"], r["iy"]): (r["valid"], r["share_a"]) for r in lattice.class_shares(cells, pixels, ["a", "b"], 100.0).collect()}
    assert len(got) == 1600 and got[-1, -1] == (3, 2 / 3) and got[1, 0] == (1, 1.0) and got[0, 0] == (0, None)
    thin = lattice.thinned(cells, 100.0, 450.0, 3)
    blocks = Counter((math.floor(r["ix"] * 100 / 450), math.floor(r["iy"] * 100 / 450)) for r in thin.collect())
    assert set(blocks.values()) == {1} and len(blocks) == 100
    core = spark.createDataFrame([(300.0, 0.0, 500.0, 100.0)], BOX)
    placed = lattice.in_sectors(thin, core, 100.0)
    have = Counter(r["sector"] for r in placed.collect())
    drawn = lattice.by_sector(placed, 30, 3).collect()
    taken = Counter(r["sector"] for r in drawn)
    quota = {s: max(1, round(30 * c / 100)) for s, c in have.items()}
    assert len(drawn) == min(30, sum(quota.values())) and all(taken[s] <= q for s, q in quota.items()) and drawn == lattice.by_sector(placed, 30, 3).collect()


def test_root_sample(spark):
    strata = {("a", 1): 400, ("a", None): 100, (None, 1): 25, ("b", 2): 3, ("c", 2): 1}
    rows = [(s, t, f"{s}{t}{i}", f"{s}{t}u{i // 2}") for (s, t), n in strata.items() for i in range(n)]
    df = spark.createDataFrame(rows, "s string, t int, k string, u string")
    got = lattice.root_sample(df, ["s", "t"], "u", "k", 60, 9).collect()
    roots = sum(math.sqrt(n) for n in strata.values())
    ideal = {k: math.sqrt(n) / roots * 60 for k, n in strata.items()}
    given = {k: min(n, max(1, int(ideal[k]))) for k, n in strata.items()}
    rest = 60 - sum(given.values())
    for k in sorted((k for k in strata if given[k] < strata[k]), key=lambda k: -(ideal[k] - int(ideal[k])))[:rest]:
        given[k] += 1
    units = {k: -(-n // 2) for k, n in strata.items()}
    assert Counter((r["s"], r["t"]) for r in got) == {k: min(given[k], units[k]) for k in strata}
    assert len({(r["s"], r["t"], r["u"]) for r in got}) == len(got) and sorted(map(repr, got)) == sorted(map(repr, lattice.root_sample(df, ["s", "t"], "u", "k", 60, 9).collect()))
    assert lattice.root_sample(df.limit(0), ["s", "t"], "u", "k", 5, 1).count() == 0
