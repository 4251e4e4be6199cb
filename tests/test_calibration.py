"""Isotonic fits against the min-max rule, levels against interpolation, classes that sum to one."""

from __future__ import annotations

import numpy as np
import pytest

from evidra.operators import calibration


def min_max(x, y, w):
    """Scores and levels by max over starts of min over ends of the mean between."""
    at = np.unique(x)
    s, n = np.array([(y * w)[x == v].sum() for v in at]), np.array([w[x == v].sum() for v in at])
    cs, cn = np.r_[0, s.cumsum()], np.r_[0, n.cumsum()]
    mean = lambda a, b: (cs[b + 1] - cs[a]) / (cn[b + 1] - cn[a])
    return at, np.array([max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))])


def test_levels_match_min_max_and_interpolation(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    probe = np.r_[rng.random(40) * 1.4 - 0.2, [0.0, 1.0]]
    for g, n in (("a", 120), (None, 60), ("one", 1), ("flat", 30)):
        x = np.round(rng.random(n), 2)
        y = (rng.random(n) < x).astype(float) if g != "flat" else 1 - np.round(x)
        w = rng.integers(1, 4, n).astype(float)
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)]
        at, level = min_max(x, y, w)
        want[g] = np.interp(np.r_[at, probe], at, level)
        want[g] = (np.r_[at, probe], want[g])
    nan = float("nan")
    odd = [("a", None, 1.0, 1.0), ("a", nan, 1.0, 1.0), ("a", 0.5, None, 1.0), ("a", 0.5, 1.0, 0.0), ("a", float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "g string, x double, y double, w double").repartition(5)
    blocks = calibration.isotonic(df, ["g"], "x", "y", "w")
    asked = [(g, float(v), float(z), 1) for g, (xs, zs) in want.items() for v, z in zip(xs, zs, strict=True)]
    q = spark.createDataFrame(asked + [("a", None, None, 1), ("a", nan, None, 1), ("other", 0.5, None, 1)], "g string, x double, want double, low int").repartition(3)
    got = calibration.calibrated(q, ["g"], "x", blocks).collect()
    assert len(got) == len(asked) + 3 and {r["level"] for r in got if r["want"] is None} == {None}
    # between two scores of one block and the next the line runs from the block's end, where the rule of all scores bends at every score
    ends = {(r["_group"]): [] for r in blocks.collect()}
    for r in sorted(blocks.collect(), key=lambda r: r["low"]):
        ends[r["_group"]] += [(r["low"], r["level"]), (r["high"], r["level"])]
    for r in got:
        if r["want"] is not None:
            key = '{"g":null}' if r["g"] is None else f'{{"g":"{r["g"]}"}}'
            xs, ys = zip(*ends[key], strict=True)
            assert r["level"] == pytest.approx(np.interp(r["x"], xs, ys), abs=1e-12)
            assert r["level"] == pytest.approx(r["want"], abs=1e-9)
    levels = sorted((r["low"], r["level"]) for r in blocks.collect() if r["_group"] == '{"g":"a"}')
    assert all(a[1] < b[1] for a, b in zip(levels, levels[1:]))
    assert calibration.isotonic(df.limit(0), ["g"], "x", "y").count() == 0 and calibration.calibrated(q, ["g"], "x", calibration.isotonic(df.limit(0), ["g"], "x", "y")).count() == len(got)


def test_batches_may_be_cut_anywhere():
    import pandas as pd

    rng = np.random.default_rng(3)
    x, y = np.arange(200.0), (rng.random(200) < np.arange(200) / 200).astype(float)
    whole = pd.DataFrame({"_group": "g", "low": x, "high": x, "sum": y, "weight": 1.0})
    told = lambda batches, all_: pd.concat([b for b in calibration.pooled(iter(batches), all_) if len(b)], ignore_index=True)
    parts = [told([p], False) for p in (whole[:13], whole[13:14], whole[14:150], whole[150:])]
    assert told([whole], True).equals(told(parts, True))


def test_classes_sum_to_one(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        p = rng.dirichlet([1, 1, 1])
        truth = rng.choice(3, p=p)
        rows += [(i, c, float(p[j]), int(truth == j)) for j, c in enumerate("abc")] + [(i, "never", 0.0, 0)]
    df = spark.createDataFrame(rows, "item int, kind string, p double, truth int")
    got = calibration.calibrated_classes(df, ["item"], "kind", "p", "truth").collect()
    total = np.zeros(200)
    for r in got:
        total[r["item"]] += r["p_calibrated"]
    assert len(got) == 800 and np.allclose(total, 1) and {r["p_calibrated"] for r in got if r["kind"] == "never"} == {0.0}
