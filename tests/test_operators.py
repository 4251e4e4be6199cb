"""Planted properties of the operators on small fixtures."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.functions import calendar, names, normalise
from evidra.operators import findings, guard, ledger, lifecycle, match, stats, states, timeseries, windows
from evidra.sources import tables
from evidra.streaming import windows as stream


def test_whittaker_solves_the_normal_equations():
    rng = np.random.default_rng(0)
    for n in (3, 4, 5, 30):
        y, w = rng.normal(size=n), (rng.random(n) > 0.3).astype(float)
        d = np.diff(np.eye(n), 2, axis=0)
        want = np.linalg.solve(np.diag(w + 1e-9) + 10 * d.T @ d, w * y)
        assert np.allclose(timeseries.whittaker(y, w, 10.0), want, atol=1e-5)
    line = 0.2 + 0.01 * np.arange(60)
    assert np.abs(timeseries.whittaker(line, np.ones(60), 100.0) - line).max() <= 1e-3


def test_robust_pass_beats_plain_at_a_planted_dip():
    x = np.arange(80)
    truth = 0.5 + 0.2 * np.sin(x / 12)
    seen = truth + np.random.default_rng(1).normal(0, 0.005, 80)
    seen[40] -= 0.4
    ones = np.ones(80)
    assert abs(timeseries.robust_whittaker(seen, ones, 50.0)[40] - truth[40]) < abs(timeseries.whittaker(seen, ones, 50.0)[40] - truth[40]) / 3


def test_peaks_need_height_and_prominence():
    assert timeseries.peaks(np.array([0, 0.5, 0.1, 0.6, 0.6, 0.6, 0.55, 0.58, 0.1])) == [1, 4]


@pytest.mark.parametrize(("day", "year", "season"), [(date(2020, 5, 31), 2019, "summer"), (date(2020, 6, 1), 2020, "kharif"), (date(2020, 9, 30), 2020, "kharif"), (date(2020, 10, 1), 2020, "rabi"), (date(2021, 1, 31), 2020, "rabi"), (date(2021, 2, 1), 2020, "rabi"), (date(2020, 2, 29), 2019, "rabi"), (date(2020, 3, 1), 2019, "summer"), (date(2019, 12, 31), 2019, "rabi")])
def test_seasons_at_their_bounds(spark, day, year, season):
    row = spark.createDataFrame([(day,)], "d date").select(calendar.ag_year(F.col("d")), calendar.season(F.col("d"))).first()
    assert tuple(row) == (year, season)


def test_numbers_amounts_and_dates(spark):
    df = spark.createDataFrame([("Rs. 12,34,567.50 (3 items)",), ("1.234.567",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(normalise.amount(F.col("t"))).collect()] == [1234567, 1234567, None, None]
    df = spark.createDataFrame([("1.25.50",), ("1-25.50",), ("0.405",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(normalise.extent_ha(F.col("t"))).collect()] == [1.255, 1.255, 0.405, None, None]
    df = spark.createDataFrame([("on 31/12/2021",), ("31/02/2021 or March 2022",), ("5 march 2023",), ("in 2024",), ("in 1999",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(normalise.parse_date(F.col("t"))).collect()]
    assert got == [(date(2021, 12, 31), "day"), (date(2022, 3, 1), "month"), (date(2023, 3, 5), "day"), (date(2024, 1, 1), "year"), (None, None), (None, None)]
    assert spark.range(1).select(normalise.find_dates(F.lit("1/2/2021, 45/1/2021 and 3-4-2022"))).first()[0] == [date(2021, 2, 1), date(2022, 4, 3)]


def records_of(spark, rows):
    """(id, village, survey_no, sub_div, block, unit, extent, from_header)"""
    names = "id long, village string, survey_no string, sub_div string, block int, unit int, extent double, from_header boolean, header_conflict boolean, scheme_header boolean"
    return spark.createDataFrame([(*r, False, False) for r in rows], names)


def test_links_by_tier_list_and_village(spark):
    units = spark.createDataFrame(
        [("a1", "A", "168/2", 1, 1, 1.0), ("a2", "A", "10/1A", 1, 1, 1.0), ("a3", "A", "10/1B", 1, 1, 1.0), ("a4", "A", "7", 1, 1, 1.0), ("a5", "A", "53/8", 1, 1, 1.0), ("b1", "B", "168/2", 2, 1, 1.0), ("b2", "B", "99/1", 2, 1, 1.0)],
        "uid string, village string, code string, block int, unit int, area double",
    )
    rows = [
        (1, "A", "168", "2", None, None, None, False), (2, "A", "௦168-", " 2 (plot)", None, None, None, False), (3, "A", "10", None, None, None, None, False), (4, "A", "10", "1", None, None, None, False), (5, "A", "53", "3", None, None, None, False),
        (6, "C", "168", "2", None, None, None, False), (7, "A", "", None, None, None, None, False), (8, "A", "7", "", None, None, None, False), (9, "A", "10", "1A, 1B", None, None, None, False), (10, "A", "10/1A", "168/2; 77/7", None, None, None, False),
        (11, "C", "99", "1", 2, 1, None, False), (12, "A", "99", "1", 2, 1, None, False), (13, "A", "99", "1", 2, 1, None, True), (14, "A", "168", "2", 2, None, 9.0, False), (15, None, None, None, None, None, None, False), (16, "A", "888", None, None, None, None, False),
    ]
    got = {r["id"]: (r["village"], r["status"], r["uid"], [tuple(x) for x in r["links"] or []]) for r in match.link(records_of(spark, rows), units).collect()}
    assert got[1] == ("A", "accepted", "a1", [("a1", "parcel", 1.0)]) and got[2][1:3] == ("accepted", "a1")
    assert got[3][1] == "survey_level" and got[3][3] == [("a2", "survey_level", 0.85), ("a3", "survey_level", 0.85)]
    assert got[4][1:3] == ("ambiguous", None) and got[5][1] == "ambiguous" and got[6][1] == "no_village" and got[7][1] == "no_ref" and got[15][1] == "no_ref" and got[16][1] == "no_candidate"
    assert got[8] == ("A", "accepted", "a4", [("a4", "parcel", 1.0)])
    assert got[9][1] == "list" and got[9][3] == [("a2", "list_member", 1.0), ("a3", "list_member", 1.0)] and got[10][1] == "list_partial" and [x[0] for x in got[10][3]] == ["a2", "a1"]
    assert got[11][:3] == ("B", "accepted", "b2") and got[12][1] == "no_candidate" and got[13][:3] == ("B", "accepted", "b2")
    assert got[14][1:] == ("accepted", "a1", [("a1", "parcel", 0.8)])  # another block, far too large
    reasons = match.link(records_of(spark, rows[13:14]), units).first()["candidates"][0][0]["reasons"]
    assert reasons == ["exact", "block_disagree", "extent_far"]


def test_references_of_a_record(spark):
    cases = [("26", "1E,42/4C", [("26", "1E"), ("42", "4C")]), ("1", "6,7,8,10A", [("1", "6"), ("1", "7"), ("1", "8"), ("1", "10A")]), ("173/1", None, [("173", "1")]), ("173/1", "2", [("173", "1"), ("173", "2")]), ("00394", "", [("394", "")]), (None, "4/2 and 4/2", [("4", "2")]), (None, "5", []), ("12", "௧-அ", [("12", "1A")])]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").select(normalise.parse_refs(F.col("a"), F.col("b")).alias("r"))
    assert [[tuple(x) for x in r["r"]] for r in df.collect()] == [c for _, _, c in cases]
    got = spark.range(1).select(normalise.ocr_variants(F.lit("63"))).first()[0]
    assert sorted((v["variant"], v["swaps"]) for v in got) == [("03", 1), ("08", 2), ("53", 1), ("58", 2), ("63", 0), ("68", 1)]


def test_post_possession_rules(spark):
    did = "struct<did:double,ci_lo:double,ci_hi:double,farmland_like_p:double>"
    df = spark.createDataFrame([("V|1", "parcel", (-1.0, -2.0, -0.1, 0.5), (0.1, -0.2, 0.4, 0.9)), ("V|2", "block", (0.0, -1.0, 1.0, 0.5), (0.5, 0.1, 0.9, 0.8))], f"parcel_uid string, possession_level string, vigour {did}, plough {did}")
    got = [(r["parcel_uid"], r["finding"], r["severity"], round(r["confidence"], 2)) for r in findings.post_possession(df).collect()]
    assert sorted(got) == [("V|1", "drop", "medium", 0.7), ("V|2", "farmed_lead", "low", 0.35)]


def test_tampered_ledger_is_found(spark):
    df = spark.createDataFrame([("r", i, f"p{i}") for i in range(5)], "run string, seq long, payload string")
    good = ledger.chain(df, "run", "seq", "payload")
    assert ledger.verify(good, "run", "seq", "payload").first()["ok"]
    assert ledger.verify(good.where("seq <> 2"), "run", "seq", "payload").first()["first_bad"] == 3
    assert ledger.verify(good.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload"))), "run", "seq", "payload").first()["first_bad"] == 3


@pytest.mark.parametrize(("sql", "fine"), [("select * from v", True), ("with c as (select a from v) select * from c union select 1", True), ("select a from v where a in (select a from v)", True), ("drop table v", False), ("delete from v", False), ("select 1; select 2", False), ("select * from hidden", False), ("select a from v where a in (select a from hidden)", False), ("select reflect('java.lang.System', 'exit') from v", False), ("insert into v select 1", False), ("create table t as select * from v", False), ("selec", False)])
def test_guard(spark, sql, fine):
    spark.range(10).toDF("a").createOrReplaceTempView("v")
    spark.range(10).toDF("a").createOrReplaceTempView("hidden")
    if fine:
        assert guard.guarded(spark, sql, ["v"], 3).count() <= 3
    else:
        with pytest.raises(guard.Refused):
            guard.guarded(spark, sql, ["v"])


def test_keyed_writes_and_tolerance(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    new = spark.createDataFrame([(2, 2.00001), (3, None)], "k long, v double")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, 1.0), (2, 2.00001), (3, None)]
    assert [r["k"] for r in tables.changed_rows(old, new, ["k"], {"v": 1e-4}).collect()] == [3]
    assert tables.changed_rows(new, new, ["k"], {"v": None}).count() == 0


def test_runs_treat_null_as_a_value(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", "x", None, None, "x"])], "k string, i long, v string")
    assert [(r["v"], r["n"]) for r in windows.runs(df, ["k"], "i", "v").orderBy("run").collect()] == [("x", 2), (None, 2), ("x", 1)]


def test_ties_are_mixed_and_nan_does_not_count(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", float("nan")), ("b", "x", 3.0)], "k string, s string, v double")
    assert {(r["k"], r["dominant"]) for r in stats.dominant(df, ["k"], "s").collect()} == {("a", "mixed"), ("b", "x")}
    assert df.agg(stats.median("v")).first()[0] == 2.0


def test_isotonic_levels_rise():
    levels = [v for _, v in states.pool_adjacent([0.1, 0.2, 0.3, 0.4], [0, 1, 0, 1])]
    assert levels == sorted(levels) == [0, 0.5, 1]


def test_streams_match_their_batch_twins(spark, sf_dir, tmp_path):
    source = tmp_path / "events"
    batch = stream.event_batch(spark, f"{sf_dir}/events.parquet")
    batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(1).write.parquet(str(source))
    live = stream.event_stream(spark, str(source))
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    rounded = lambda df: df.withColumn("total", F.round("total", 4))
    assert same(rounded(stream.run_to_memory(stream.tumbling(live), "tumbling_out", "complete", str(tmp_path / "a"))), rounded(stream.tumbling(batch)))
    assert same(stream.run_to_memory(stream.breaker(live), "breaker_out", "append", str(tmp_path / "b")), stream.breaker(batch))
    assert stream.run_to_memory(stream.first_seen(live, ["user_id", "event_type"]), "first_out", "append", str(tmp_path / "c")).count() == stream.first_seen(batch, ["user_id", "event_type"]).count()
    closed = stream.run_to_memory(stream.sessions(live), "sessions_out", "append", str(tmp_path / "d"))
    assert 0 < closed.count() <= stream.sessions(batch).count() and closed.exceptAll(stream.sessions(batch)).count() == 0


def test_breaker_opens_and_probes(spark):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    seconds = [0, 1, 2, 3, 70, 71, 72]
    kinds = ["error", "error", "error", "view", "error", "view", "view"]
    df = spark.createDataFrame([(1, i, at + timedelta(seconds=s), k) for i, (s, k) in enumerate(zip(seconds, kinds))], "user_id long, event_id long, ts timestamp, event_type string")
    assert [r["state"] for r in stream.breaker(df).orderBy("event_id").collect()] == ["closed", "closed", "closed", "open", "half_open", "open", "open"]


def test_season_windows_and_event_dates(spark):
    rows = spark.createDataFrame([(2019, "rabi"), (2020, "kharif"), (2020, "summer"), (2020, "annual")], "y int, s string")
    got = [tuple(r[0]) for r in rows.select(calendar.season_window(F.col("y"), F.col("s"))).collect()]
    assert got == [(date(2019, 10, 1), date(2020, 2, 29)), (date(2020, 6, 1), date(2020, 9, 30)), (date(2021, 3, 1), date(2021, 5, 31)), (date(2020, 6, 1), date(2021, 5, 31))]
    late = spark.createDataFrame([(date(2021, 1, 1), date(2020, 1, 1), date(2022, 1, 1))], "n date, a date, p date")
    with pytest.raises(Exception, match="out of order"):
        late.select(calendar.event_windows(F.col("n"), F.col("a"), F.col("p"), F.lit("2023-01-01").cast("date"))).collect()


def test_season_rule_states(spark):
    """Planted seasons: each state by the feature that makes it."""
    cases = [
        ("rabi", False, 0.6, 0.1, 0.5, 0.2, -0.3, 1, 0.1, 0.0, "insufficient_data"), ("rabi", True, None, 0.1, 0.5, 0.2, -0.3, 1, 0.1, 0.0, "insufficient_data"),
        ("rabi", True, 0.1, 0.0, 0.1, 0.05, 0.2, 0, 0.1, 0.0, "water"), ("rabi", True, 0.25, 0.15, 0.1, 0.2, -0.3, 0, 0.35, -0.2, "cleared_or_built"), ("rabi", True, 0.25, 0.15, 0.1, 0.2, -0.3, 0, 0.35, None, "bare_fallow"),
        ("rabi", True, 0.55, 0.4, 0.15, 0.45, -0.3, 1, 0.3, 0.0, "perennial_veg"), ("rabi", True, 0.6, 0.2, 0.4, 0.25, -0.3, 1, 0.3, 0.0, "cropped"), ("rabi", True, 0.4, 0.2, 0.2, 0.25, -0.3, 0, 0.3, 0.0, "bare_fallow"),
        ("kharif", True, 0.5, 0.2, 0.3, 0.3, -0.3, 1, 0.3, 0.0, "cropped"), ("summer", True, 0.5, 0.35, 0.15, 0.4, -0.3, 1, 0.3, 0.0, "perennial_veg"), ("kharif", True, 0.3, 0.2, 0.1, 0.25, -0.3, None, 0.3, 0.0, "bare_fallow"),
    ]
    names = "season string, ok boolean, mx double, mn double, amp double, dry double, wet double, peaks int, nbr double, yoy double, want string"
    df = spark.createDataFrame(cases, names)
    state = states.season_rule(*[F.col(c) for c in ("season", "ok", "mx", "mn", "amp", "dry", "wet", "peaks", "nbr", "yoy")])
    assert [(r["s"], r["want"]) for r in df.select(state.alias("s"), "want").collect()] == [(c[-1], c[-1]) for c in cases]


def test_votes(spark):
    cases = [
        ("a", "a", "a", 0.1, "a", "3of3"), ("a", "b", "a", 0.1, "a", "2of3"), ("a", "b", "c", 0.9, None, "none"), ("a", None, "a", 0.1, "a", "2of2"), ("a", "", "b", 0.6, "a", "split_vlm"),
        ("a", None, "b", 0.59, None, "split"), ("a", "b", None, 0.9, None, "split"), (None, None, "b", 0.9, None, "single"), (None, None, None, 0.9, None, "none"),
    ]
    df = spark.createDataFrame(cases, "one string, two string, prior string, p double, label string, outcome string")
    got = df.select(states.vote({k: F.col(k) for k in ("one", "two", "prior")}, {"one": F.col("p"), "two": F.col("p")}).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [c[-2:] for c in cases]


def test_annual_states(spark):
    rows = [(1, 1, "cropped", 0.7), (1, 2, "cropped", 0.6), (2, 1, "irrigated_multi", 0.9), (3, 1, "cropped", 0.8), (3, 2, "bare_fallow", 0.1), (4, 1, "insufficient_data", None), (4, 2, "bare_fallow", 0.5), (5, 1, "insufficient_data", None), (6, 1, "water", 0.4), (6, 2, "bare_fallow", 0.3)]
    df = spark.createDataFrame(rows, "k long, ord long, state string, p double")
    got = {r["k"]: (r["annual_state"], r["p_state"]) for r in states.annual_state(df, ["k"], "state", "p", "ord").collect()}
    assert got == {1: ("irrigated_multi", 0.6), 2: ("irrigated_multi", 0.9), 3: ("cropped", 0.8), 4: ("bare_fallow", 0.5), 5: ("insufficient_data", None), 6: ("water", 0.4)}


def test_short_series_are_their_mean_and_peaks_survive():
    nan = float("nan")
    assert timeseries.whittaker(np.array([0.2, 0.4]), np.ones(2), 10.0).tolist() == [pytest.approx(0.3)] * 2
    assert timeseries.whittaker(np.array([nan, 0.4, nan, nan]), np.array([0.0, 1, 0, 0]), 10.0).tolist() == [0.4] * 4
    clean = 0.2 + 0.5 * np.exp(-(((np.arange(120) - 60) / 12.0) ** 2))
    assert timeseries.robust_whittaker(clean, np.ones(120), 100.0).max() > 0.65  # the floor of the scale keeps true peaks
    up = clean.copy()
    up[30] += 0.5  # outliers above count like those below
    assert abs(timeseries.robust_whittaker(up, np.ones(120), 100.0)[30] - clean[30]) < 0.03


def test_did_interval_against_numpy(spark):
    rng = np.random.default_rng(3)
    z, c = rng.normal(0, 1, (6, 8)), rng.normal(0, 1, (40, 8))
    z[:, 4:] += np.array([0, 0, 3, 3, -3, -3])[:, None]
    z[0, 1] = z[1, 4:] = np.nan
    long = lambda m: [(i, s, None if np.isnan(v) else float(v)) for i, row in enumerate(m) for s, v in enumerate(row)]
    units, controls = spark.createDataFrame(long(z), "u long, s long, v double"), spark.createDataFrame(long(c), "c long, s long, v double")
    got = {r["u"]: r for r in timeseries.did_interval(units, controls, unit="u", cell="c", season="s", value="v", before=range(4), after=range(4, 8), level=-0.5).collect()}
    d = z - c.mean(axis=0)
    with np.errstate(all="ignore"):
        want = np.nanmean(d[:, 4:], axis=1) - np.nanmean(d[:, :4], axis=1)
    for u, r in got.items():
        assert (r["n_pre"], r["n_post"]) == ((~np.isnan(z[u, :4])).sum(), (~np.isnan(z[u, 4:])).sum())
        if u == 1:
            assert r["did"] is None and r["farmland_like_p"] is None
            continue
        assert r["did"] == pytest.approx(want[u]) and r["ci_lo"] < r["did"] < r["ci_hi"] and 0 <= r["farmland_like_p"] <= 1
    assert got[2]["ci_lo"] > 0 > got[4]["ci_hi"]
    boot = np.array([np.nanmean((z[5] - c[rng.integers(0, 40, 40)].mean(axis=0))[4 + rng.integers(0, 4, 4)]) - np.nanmean((z[5] - c[rng.integers(0, 40, 40)].mean(axis=0))[rng.integers(0, 4, 4)]) for _ in range(3000)])
    lo, hi = np.percentile(boot, [2.5, 97.5])
    assert abs(got[5]["ci_lo"] - lo) < 0.4 and abs(got[5]["ci_hi"] - hi) < 0.4


def test_nearest_and_pairs_are_complete(spark):
    from evidra.operators import records, spatial

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e5, 0.0)], "id long, x double, y double")
    targets = spark.createDataFrame([(7, 1.0, 0.0)], "target long, tx double, ty double")
    assert sorted((r["id"], r["distance"]) for r in spatial.nearest(points, targets, 0.5).collect()) == [(1, 1.0), (2, 899999.0)]
    assert spatial.nearest(points, targets.limit(0), 0.5).count() == 0
    chain = [("g", i, j, float(-(i + j))) for i in range(12) for j in (i, i + 1)]  # one mutual best a round
    got = sorted((r["a"], r["b"]) for r in records.greedy_pairs(spark.createDataFrame(chain, "g string, a long, b long, s double"), "g", "a", "b", "s").collect())
    taken, used = [], (set(), set())
    for _, a, b, _ in sorted(chain, key=lambda r: (-r[3], r[1], r[2])):
        if a not in used[0] and b not in used[1]:
            taken.append((a, b))
            used[0].add(a)
            used[1].add(b)
    assert got == sorted(taken)


def test_nearest_ranks_match_sorting(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.lognormal(0, 3, 500)] + [("b", 1.0)] * 30 + [("c", 5.0), ("d", None), ("a", None)] + [("e", float(x)) for x in rng.integers(0, 3, 50)]
    got = {r["k"]: (r["p50"], r["p95"]) for r in stats.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in "abce":
        v = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k] == tuple(v[round(p * (len(v) - 1))] for p in (0.5, 0.95))
    assert "d" not in got


def test_amounts_extents_and_words(spark):
    one = lambda f, texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]
    assert one(normalise.amount, ["₹12,60,000/-", "***10,23,687.00", "ரூ.95,64,800/-", "10.23.687.00", "six lakh twelve thousand", ""]) == [1260000, 1023687, 9564800, 1023687, 612000, None]
    assert one(normalise.extent_ha, ["0.95.50", "0 - 53.50", "185.96.5", "053.50", "11.31.00 ஹெக்டேர் (27.947 ஏக்கர்)", "0:10.50", "௧.௦௦.௫௦", "abc"]) == [0.955, 0.535, 185.965, 0.535, 11.31, 0.105, 1.005, None]
    assert one(normalise.extent_ac, ["2.35", "2.124 (ஏக்கர்)", "x"]) == [2.35, 2.124, None] and one(normalise.cents, ["4", "3½ cents", ".5", "x"]) == [4.0, 3.5, 0.5, None]
    assert one(normalise.number_words, ["two crore three lakh forty-five", "hundred", "rupees only", None]) == [20300045, 100, None, None]
    df = spark.createDataFrame([(1.0, 2.47), (1.0, 2.4711), (1.0, 2.52), (20.0, 49.45), (None, 1.0)], "h double, a double")
    assert [r[0] for r in df.select(normalise.extents_agree(F.col("h"), F.col("a"))).collect()] == [True, True, False, True, None]


def test_ratio_is_that_of_the_longest_common_subsequence(spark):
    from functools import lru_cache

    from evidra.functions import names

    rng = np.random.default_rng(1)
    pairs = [("".join(rng.choice(list("abc"), rng.integers(0, 9))), "".join(rng.choice(list("abc"), rng.integers(0, 9)))) for _ in range(60)] + [("", ""), ("kitten", "sitting"), ("é", "é")]

    @lru_cache(None)
    def common(a, b):
        return 0 if not a or not b else common(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(common(a[:-1], b), common(a, b[:-1]))

    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(names.ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(200 * common(a, b) / (len(a) + len(b)) if a or b else 100) for a, b in pairs]
    assert spark.range(1).select(names.token_sort_ratio(F.lit("Rajan  Kumar"), F.lit("kumar rajan"))).first()[0] == 100


def test_owners_and_keys(spark):
    from evidra.functions import names

    cases = [("1. Thiru. Muthu S/o Raman", "Muthu", "father", "Raman", "Thiru"), ("ராமன் மகன் முத்து", "முத்து", "father", "ராமன்", None), ("Smt Lakshmi, W/o. Mr Kannan", "Lakshmi", "husband", "Kannan", "Smt"), ("Plain Name", "Plain Name", None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").coalesce(1).select(names.owner(F.col("t")).alias("o")).select("o.*")
    assert [(r["name"], r["relation"], r["relation_name"], r["honorific"]) for r in df.collect()] == [c[1:] for c in cases]
    owners = spark.createDataFrame([("1. A த/பெ B\n2. C க/பெ D",), ("A ; C",), ("முத்து\nத/பெ. ராமன்",), ("",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in owners.select(names.split_owners(F.col("t"))).collect()] == [["A த/பெ B", "C க/பெ D"], ["A", "C"], ["முத்து த/பெ. ராமன்"], [], []]
    keys = spark.createDataFrame([("முத்து",), ("Muththu",), ("Shanmugam  Pillai",), ("சண்முகம்",)], "t string").coalesce(1).select(names.latin_key(F.col("t"))).collect()
    assert keys[0][0] == keys[1][0] == "mutu" and keys[2][0] == "sanmugam pilai" and keys[3][0] == "canmukam"


def test_queries_without_sql_give_right_values(spark, sf_dir):
    """What SQL doesn't check: smoothing by the normal equations, peaks, breaker and pairs by plain Python."""
    from evidra.plans.registry import QUERIES

    import pandas as pd

    events = pd.read_parquet(f"{sf_dir}/events.parquet")
    events["day"] = events["ts"].dt.date
    smooth = QUERIES["q44_whittaker"](spark, sf_dir).toPandas()
    for kind, part in events.groupby("event_type"):
        daily = part.groupby("day")["value"].mean() / 100
        days = pd.date_range(min(daily.index), max(daily.index)).date
        y = daily.reindex(days).to_numpy()
        w = (~np.isnan(y)).astype(float)
        d = np.diff(np.eye(len(y)), 2, axis=0)
        solve = lambda u: np.linalg.solve(np.diag(u + 1e-9) + 10 * d.T @ d, u * np.nan_to_num(y))
        z = solve(w)
        for _ in range(2):
            r = np.where(w > 0, y - z, 0)
            s = max(1.4826 * np.median(np.abs(r[w > 0])), 0.03)
            z = solve(w * np.where(np.abs(r) < 4.685 * s, (1 - (r / (4.685 * s)) ** 2) ** 2, 0))
        mine = smooth[smooth["event_type"] == kind].sort_values("day")["v"].to_numpy()
        assert np.allclose(mine, z, atol=1e-6)
    peaks = QUERIES["q45_peaks"](spark, sf_dir).toPandas()
    assert len(peaks) > 0 and peaks["v"].notna().all()
    states_ = QUERIES["q85_breaker"](spark, sf_dir).toPandas().set_index("event_id")["state"].to_dict()
    for _, part in events.sort_values(["ts", "event_id"]).groupby("user_id"):
        count, opened = 0, None
        for i, kind, ts in zip(part["event_id"], part["event_type"], part["ts"]):
            at = ts.timestamp()
            name = "closed" if opened is None else "open" if at - opened < 60 else "half_open"
            assert states_[i] == name
            if name == "open":
                continue
            if kind != "error":
                count, opened = 0, None
            else:
                count += 1
                opened = at if name == "half_open" or count >= 3 else None
    pairs = QUERIES["q105_greedy_pairs"](spark, sf_dir).toPandas()
    lines = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    lines["b"] = lines["l_suppkey"] % 5
    best = lines.groupby(["l_orderkey", "l_linenumber", "b"])["l_quantity"].max().reset_index().sort_values(["l_orderkey", "l_quantity", "l_linenumber", "b"], ascending=[True, False, True, True])
    want, used = set(), set()
    for g, a, b in best[["l_orderkey", "l_linenumber", "b"]].itertuples(index=False):
        if ("a", g, a) not in used and ("b", g, b) not in used:
            want.add((g, a, b))
            used |= {("a", g, a), ("b", g, b)}
    assert set(pairs[["g", "a", "b"]].itertuples(index=False, name=None)) == want
    found = QUERIES["q87_did_interval"](spark, sf_dir).toPandas()
    assert len(found) == (events["user_id"].drop_duplicates() % 3 != 0).sum() and (found["ci_lo"].dropna() <= found["ci_hi"].dropna()).all()


def test_spellings_that_differ_in_vowel_signs_are_one_village(spark):
    row = spark.createDataFrame([("பேரூரணி", "பேருரணி கிராமம்", "Per_urani-Village", None)], "a string, b string, c string, d string")
    assert tuple(row.select(*[names.fold(F.col(c)) for c in "abcd"]).first()) == ("பரரண", "பரரண", "perurani", "")


def test_rates_leave_out_what_pays_nothing(spark):
    paid = [("d", 0.0)] * 4 + [("d", 500_000.0)] * 3 + [("e", 300.0)] * 3 + [("f", None)] * 3 + [("g", 100_000.0)] * 2
    rows = spark.createDataFrame([(d, p, 1.0) for d, p in paid], "doc string, paid double, size double")
    got = [(r["doc"], r["rate"], r["support"], r["rows"]) for r in findings.modal_rate(rows, ["doc"], F.col("paid"), F.col("size")).collect()]
    assert got == [("d", 500_000.0, 3, 3)]


def test_missing_thresholds_have_defaults(spark):
    from datetime import date

    parcels = spark.createDataFrame([("p",), ("q",)], "parcel_uid string")
    events = spark.createDataFrame([("p", "AWARD", date(2020, 1, 1), "parcel"), ("q", "PAYMENT", date(2020, 1, 1), "parcel")], "parcel_uid string, stage string, day date, link_kind string")
    limits = spark.createDataFrame([("pay", 100.0)], "key string, value double")
    flags = lambda table: {r["parcel_uid"]: r["stalled_flag"] for r in lifecycle.parcel_lifecycle(
        parcels, events, stages=["AWARD", "PAYMENT", "EXEMPTION"], exempt="EXEMPTION", mandatory=["AWARD"], following={}, stalls={"AWARD": ("UNPAID", "pay", 60.0), "PAYMENT": ("NOT_HELD", "hold", 30.0)}, thresholds=table, as_of=F.lit("2020-03-11").cast("date")).collect()}
    assert flags(limits) == {"p": None, "q": "NOT_HELD"} and flags(limits.limit(0)) == {"p": "UNPAID", "q": "NOT_HELD"}
