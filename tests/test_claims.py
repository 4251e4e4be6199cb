"""Checks, evidence, refutation and verdicts of planted claims."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidra.operators import claims

FORM = "claim_id string, kind string, subject string, field string, value double, label string, checks array<string>"
FACTS = "subject string, field string, value double, label string"


def run(spark, name, field="x", value=None, label=None, **facts):
    rows = [("s", k, float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, str) else None) for k, v in facts.items()]
    found = claims.checks(spark.createDataFrame([("c", "number", "s", field, value, label, [name])], FORM), spark.createDataFrame(rows, FACTS)).first()
    return found["passed"], found["reason"]


@pytest.mark.parametrize(
    ("name", "claim", "facts", "outcome"),
    [
        ("equal", {"value": 100.0}, {"x": 100.00005}, (True, None)), ("equal", {"value": 100.0}, {"x": 100.1}, (False, "differs")), ("equal", {"label": "wet"}, {"x": "wet"}, (True, None)), ("equal", {"label": "wet"}, {"y": "wet"}, (False, "differs")),
        ("equal", {"value": 1.0}, {}, (False, "no_facts")), ("count_matches_rows", {"value": 3.0}, {"rows": 3}, (True, None)), ("union_le_sum", {}, {"area_union": 2.0, "area_sum": 1.9}, (False, "differs")), ("union_le_sum", {}, {"area_union": 1.9, "area_sum": 1.9}, (True, None)),
        ("satellite_min_obs", {}, {"n_obs": 2}, (True, None)), ("satellite_min_obs", {}, {"n_obs": 5, "data_sufficient": 0}, (False, "differs")), ("satellite_min_obs", {}, {"z": 1}, (False, "differs")),
        ("satellite_indices_agree", {"label": "cropped"}, {"amplitude": 0.2, "bsi_dry_mean": -0.1}, (False, "differs")), ("satellite_indices_agree", {"label": "cropped"}, {"amplitude": 0.2}, (True, None)), ("satellite_indices_agree", {"label": "bare_fallow"}, {"amplitude": 0.3}, (False, "differs")),
        ("satellite_indices_agree", {"label": "water"}, {"z": 1}, (True, None)), ("satellite_route_consistent", {}, {"route": "rule"}, (True, None)), ("satellite_route_consistent", {}, {"route": "rule", "needs_field": 1}, (False, "differs")), ("satellite_route_consistent", {}, {"z": 1}, (False, "differs")),
        ("crop_share_consistent", {"label": "crop"}, {"crop_share": 0.5, "coverage": 0.1}, (True, None)), ("crop_share_consistent", {"label": "no_crop"}, {"crop_share": 0.5, "coverage": 1.0}, (False, "differs")), ("crop_share_consistent", {"label": "mixed"}, {"coverage": 0.2}, (False, "differs")),
        ("crop_share_consistent", {"label": "mixed"}, {"coverage": 0.9}, (True, None)), ("fallow_streak_recount", {"value": 3.0}, {"longest_fallow": 2}, (False, "differs")), ("made_up", {"value": 3.0}, {"x": 3.0}, (False, "unknown_check")), (None, {"value": 3.0}, {"x": 3.0}, (False, "unknown_check")),
    ],
)
def test_checks(spark, name, claim, facts, outcome):
    assert run(spark, name, **claim, **facts) == outcome


def test_evidence_must_hold_the_value(spark):
    form = "claim_id string, field string, value double, evidence array<struct<ref:string,bbox:array<double>>>"
    box = [0.1, 0.1, 0.2, 0.2]
    rows = [("ok", "ha", 1.5, [("a", box), ("b", box)]), ("bad", "ha", 1.5, [("a", [0.2, 0.1, 0.1, 0.2])]), ("short", "ha", 1.5, [("a", [0.1])]), ("gone", "ha", 1.5, [("z", box)]), ("other", "ha", 1.6, [("b", box), ("a", box)]), ("none", "ha", 1.5, [])]
    known = spark.createDataFrame([("a", "ha", 1.5), ("b", "ac", 3.7)], "ref string, field string, value double")
    got = {r["claim_id"]: (r["passed"], r["reason"]) for r in claims.evidence(spark.createDataFrame(rows, form), known).collect()}
    assert got == {"ok": (True, None), "bad": (False, "bad_box"), "short": (False, "bad_box"), "gone": (False, "no_row"), "other": (False, "differs")}


def test_refutation_and_verdict(spark):
    rows = [
        ("near", "number", "s", "x", 100.9, None, ["equal"]), ("far", "number", "s", "x", 102.0, None, ["equal"]), ("exact", "number", "s", "x", 100.0, None, ["equal"]), ("open", "number", "s", "q", 1.0, None, []),
        ("thing", "entity", "s", "q", None, None, None), ("lost", "finding", "s", "q", None, None, ["equal"]), ("gone", "entity", "t", "q", None, None, ["equal"]), ("mixed", "number", "s", "x", 100.0, None, ["equal", "nope"]),
    ]
    asked = spark.createDataFrame(rows, FORM)
    facts = spark.createDataFrame([("s", "x", 100.0, None), ("s", "x", None, None), (None, "x", 1.0, None)], FACTS)
    refuted = claims.refutations(asked, facts)
    assert {r["claim_id"]: (r["refuted"], r["reason"]) for r in refuted.collect()} == {
        "near": (False, None), "far": (True, "differs"), "exact": (False, None), "open": (False, "inconclusive"), "thing": (False, None), "lost": (True, "not_reproduced"), "gone": (True, "not_reproduced"), "mixed": (False, None),
    }
    got = {r["claim_id"]: (r["supported"], r["n_checks"], r["failed"]) for r in claims.verdicts(asked, claims.checks(asked, facts), refuted).collect()}
    assert {k for k, v in got.items() if v[0]} == {"exact"} and got["mixed"] == (False, 2, ["nope"]) and got["open"] == (False, 0, [])
    none = asked.limit(0)
    assert claims.verdicts(none, claims.checks(none, facts), claims.refutations(none, facts)).count() == 0 and claims.checks(asked, facts.limit(0)).where(F.col("passed")).count() == 0
