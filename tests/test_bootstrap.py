"""Two-level bootstrap: the same weights in plain loops, and intervals against resampling with numpy."""

from __future__ import annotations

import numpy as np
import pytest

from evidra.operators import bootstrap
from evidra.plans.registry import QUERIES

PERIODS = ("baseline", "pending", "post")


def sample(n_units=60, n_cells=40, seed=4):
    rng = np.random.default_rng(seed)
    level, own = rng.normal(0, 1, n_cells), rng.normal(0.5, 1, n_units)
    controls = [(f"c{i}", y, float(level[i] + rng.normal(0, 0.3) + y)) for i in range(n_cells) for y in range(6)]
    units = [(f"u{i}", y, PERIODS[(y + i % 2) // 3 if y + i % 2 < 6 else 2], float(own[i] + rng.normal(0, 0.3) + y - (2.0 if y > 3 else 0))) for i in range(n_units) for y in range(6)]
    return units, controls


def run(spark, units, controls, parts=5, **how):
    u = spark.createDataFrame(units, "name string, y int, p string, v double").repartition(parts)
    c = spark.createDataFrame(controls, "name string, y int, v double").repartition(parts)
    found = bootstrap.period_effects(u, c, unit="name", cell="name", season="y", period="p", values=["v"], differences=[("post", "baseline"), ("pending", "baseline")], **how)
    return {r["effect"]: (r["estimate"], r["ci_lo"], r["ci_hi"], r["n"]) for r in found.collect()}


def effect(d, w, per):
    out = {p: (d * w)[per == p].sum() / w[per == p].sum() for p in PERIODS if (per == p).any()}
    return {**out, **{f"{p}-baseline": out[p] - out["baseline"] for p in ("post", "pending") if p in out}}


def test_intervals_are_close_to_resampling(spark):
    units, controls = sample()
    got = run(spark, units, controls)
    v, per = np.array([r[3] for r in units]).reshape(60, 6), np.array([r[2] for r in units]).reshape(60, 6)
    c = np.array([r[2] for r in controls]).reshape(40, 6)
    want = effect(v - c.mean(axis=0), np.ones((60, 6)), per)
    rng = np.random.default_rng(1)
    boots = []
    for _ in range(1000):
        i, j = rng.integers(0, 60, 60), rng.integers(0, 40, 40)
        boots.append(effect(v[i] - c[j].mean(axis=0), np.ones((60, 6)), per[i]))
    assert set(got) == set(want)
    for k, e in want.items():
        low, high = np.percentile([b[k] for b in boots], [2.5, 97.5])
        assert got[k][0] == pytest.approx(e) and got[k][1] == pytest.approx(low, abs=0.15 * (high - low)) and got[k][2] == pytest.approx(high, abs=0.15 * (high - low))
        assert got[k][3] == (None if "-" in k else (per == k).sum())
    assert got == {k: pytest.approx(x) for k, x in run(spark, units, controls, parts=2).items()}  # whatever the partitions


def test_replicates_are_weighted_means(spark):
    units, controls = sample(7, 5)
    hashes = {(s, n): h for s, n, h in spark.sql("select s, n, xxhash64(s, n) from values (true), (false) as a(s) cross join (select concat(k, id) as n from range(8) cross join values ('u'), ('c') as b(k))").collect()}
    w, z = (bootstrap.weights(np.array([hashes[side, r[0]] for r in rows]), 40, 11) for side, rows in ((True, units), (False, controls)))
    y, cy = np.array([r[1] for r in units]), np.array([r[1] for r in controls])
    per, v, c = np.array([r[2] for r in units]), np.array([r[3] for r in units]), np.array([r[2] for r in controls])
    boots = []
    for b in range(41):
        mean = np.array([(z[cy == s, b] * c[cy == s]).sum() / z[cy == s, b].sum() for s in range(6)])
        boots.append(effect(v - mean[y], w[:, b], per))
    for k, (e, low, high, _) in run(spark, units, controls, times=40).items():
        assert (e, low, high) == pytest.approx((boots[0][k], *np.percentile([b[k] for b in boots[1:]], [2.5, 97.5])))


def test_weights_are_poisson():
    w = bootstrap.weights(np.arange(-2000, 2000) * 7919, 200, 3)
    assert (w[:, 0] == 1).all() and w[:, 1:].mean() == pytest.approx(1, abs=0.01) and w[:, 1:].var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.06 and (w[:, 1:] == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


def test_gaps_and_empty_tables(spark):
    units, controls = sample(7, 5)
    odd = [(None, 0, "post", 1e9), ("u0", None, "post", 1e9), ("u0", 0, None, 1e9), ("u0", 0, "post", None), ("u0", 0, "post", float("nan")), ("u0", 77, "post", 1e9)]
    assert run(spark, units + odd, [*controls, (None, 0, 1e9), ("c0", None, 1e9), ("c0", 0, None)], times=20) == {k: pytest.approx(x) for k, x in run(spark, units, controls, times=20).items()}
    assert run(spark, [], controls, times=5) == {} and run(spark, units, [], times=5) == {}
    alone = run(spark, [u for u in units if u[2] == "post"], controls, times=0)
    assert set(alone) == {"post"} and alone["post"][1:3] == (None, None)
    inner = run(spark, units, controls, times=200, within=True)
    assert {k: x[0] for k, x in inner.items()} == pytest.approx({k: x[0] for k, x in run(spark, units, controls, times=0).items()}) and inner["post"][1] < inner["post"][0] < inner["post"][2]


def test_query_has_estimates_within_intervals(spark, sf_dir):
    found, plain = ({(r["metric"], r["effect"]): r for r in QUERIES[q](spark, sf_dir).collect()} for q in ("q149_period_intervals", "q148_period_effects"))
    assert len(found) == 10 and all(r["ci_lo"] <= r["estimate"] <= r["ci_hi"] and r["estimate"] == plain[k]["estimate"] for k, r in found.items())
