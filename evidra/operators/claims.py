"""Checks of claims against recomputed facts, and their refutation by an independent value.

Facts are recomputed by whatever job makes them and come as long rows: subject, field, value (a number) or label (a word). All checks of all claims are done in one pass: claims are
exploded by the checks they name, facts are one map a subject, and both meet by one join. A check that is not known fails, and so does one that lacks what it
compares with: nothing passes because it could not be looked at.

Edge cases: a claim without checks has no line in checks() and is not supported in verdicts(); facts that repeat a field count once (the largest); null subjects, fields and checks meet
nothing and fail; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative and absolute difference of equal numbers, and of a number that is not refuted.
EQUAL, NEAR = (1e-6, 1e-6), (0.01, 0.01)
#: Least observations, swing of a crop and dryness below which soil is bare, swing of a fallow, share and coverage from which a season has a crop, routes of answers.
LEAST_SEEN, CROP_SWING, BARE_DRY, FALLOW_SWING, HALF, ROUTES = 2, 0.15, -0.05, 0.3, 0.5, ("student", "vlm_second_opinion", "rule")
AREA_SLACK = 1e-4


def close(a: Column, b: Column, rel: float, abs_: float) -> Column:
    """Whether two numbers differ by no more than a share of the larger, or an absolute amount."""
    return F.abs(a - b) <= F.greatest(F.lit(abs_), rel * F.greatest(F.abs(a), F.abs(b)))


def rules(value: Column, label: Column, field: Column, number: Column, word: Column) -> dict[str, Column]:
    """Checks by name. number and word: the subject's facts by field; a null outcome counts as failed."""
    n = lambda name: F.try_element_at(number, F.lit(name))
    same = F.when(value.isNotNull(), close(F.try_element_at(number, field), value, *EQUAL)).otherwise(F.try_element_at(word, field) == label)
    wet = n("amplitude").isNotNull() & (n("amplitude") >= CROP_SWING) & F.coalesce(n("bsi_dry_mean") >= BARE_DRY, F.lit(True))
    expected = F.when(label.isin("crop", "no_crop") & n("crop_share").isNotNull(), F.when(n("crop_share") >= HALF, "crop").otherwise("no_crop")).when(F.coalesce(n("coverage"), F.lit(0.0)) < HALF, "insufficient_coverage")
    return {
        "equal": same,
        "count_matches_rows": value == n("rows"),
        "union_le_sum": F.coalesce(n("area_union"), F.lit(0.0)) <= F.coalesce(n("area_sum"), F.lit(0.0)) + AREA_SLACK,
        "satellite_min_obs": (F.coalesce(n("n_obs"), F.lit(0.0)) >= LEAST_SEEN) & F.coalesce(n("data_sufficient") != 0, F.lit(True)),
        "satellite_indices_agree": F.when(label.isin("cropped", "irrigated_multi"), wet).when(label == "bare_fallow", F.coalesce(n("amplitude") < FALLOW_SWING, F.lit(True))).otherwise(True),
        "satellite_route_consistent": F.try_element_at(word, F.lit("route")).isin(*ROUTES) & (F.coalesce(n("needs_field"), F.lit(0.0)) == 0),
        "crop_share_consistent": expected.isNull() | (expected == label) | (label == "insufficient_data"),
        "fallow_streak_recount": value == n("longest_fallow"),
    }


def by_subject(facts: DataFrame) -> DataFrame:
    """subject, _number, _word: the facts of each subject by field."""
    each = facts.where("subject is not null and field is not null").groupBy("subject", "field").agg(F.max(F.col("value").cast("double")).alias("value"), F.max("label").alias("label"))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("field", c))))
    return each.groupBy("subject").agg(pairs("value").alias("_number"), pairs("label").alias("_word"))  # as many as there are fields


def checks(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, check, passed, reason (unknown_check, no_facts, differs or null) of every check that a claim names.

    claims: claim_id, subject, field, value, label, checks (names)."""
    asked = claims.select("claim_id", "subject", "field", F.col("value").cast("double").alias("value"), "label", F.explode("checks").alias("check"))
    met = asked.join(by_subject(facts), "subject", "left")
    told = F.col("_number").isNotNull()
    outcome, known = F.lit(None).cast("boolean"), F.lit(False)
    for name, rule in rules(F.col("value"), F.col("label"), F.col("field"), F.col("_number"), F.col("_word")).items():
        outcome = F.when(F.col("check") == name, rule).otherwise(outcome)
        known = known | F.coalesce(F.col("check") == name, F.lit(False))
    passed = told & known & F.coalesce(outcome, F.lit(False))
    reason = F.when(~known, "unknown_check").when(~told, "no_facts").when(~passed, "differs")
    return met.select("claim_id", "check", passed.alias("passed"), reason.alias("reason"))


def evidence(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """claim_id, check (bbox_contains_value), passed, reason of every claim with evidence: each item's box lies within the page, and its row exists and does not say another number.

    claims: claim_id, field, value, evidence (array of struct(ref, bbox)); rows: ref, field, value of extracted rows."""
    items = claims.select("claim_id", "field", F.col("value").cast("double").alias("value"), F.explode("evidence").alias("e"))
    box = F.col("e.bbox")
    at = lambda i: F.get(box, F.lit(i))
    good = (F.size(box) == 4) & (at(0) >= 0) & (at(0) < at(2)) & (at(2) <= 1) & (at(1) >= 0) & (at(1) < at(3)) & (at(3) <= 1)
    known = rows.where("ref is not null").select(F.col("ref").alias("_ref"), F.col("field").alias("_field"), F.col("value").cast("double").alias("_value"))
    there = known.select("_ref").distinct().withColumn("_there", F.lit(True))
    said = known.where("_value is not null").groupBy("_ref", "_field").agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    items = items.withColumn("_ref", F.col("e.ref")).withColumn("_field", F.col("field")).join(there, "_ref", "left").join(said, ["_ref", "_field"], "left")
    holds = F.coalesce(close(F.col("_low"), F.col("value"), *EQUAL) & close(F.col("_high"), F.col("value"), *EQUAL), F.col("_low").isNull() | F.col("value").isNull())
    why = F.when(~F.coalesce(good, F.lit(False)), "bad_box").when(F.col("_there").isNull(), "no_row").when(~holds, "differs")
    return items.groupBy("claim_id").agg(F.min(why).alias("reason")).select("claim_id", F.lit("bbox_contains_value").alias("check"), F.col("reason").isNull().alias("passed"), "reason")


def refutations(claims: DataFrame, found: DataFrame) -> DataFrame:
    """claim_id, refuted, reason (differs, not_reproduced, inconclusive or null) by facts recomputed another way.

    claims: claim_id, kind, subject, field, value. A finding, discrepancy or entity must be found again (an entity by its subject alone); a number must come out within
    one in a hundred; what can't be compared is inconclusive, not refuted."""
    told = by_subject(found)
    met = claims.select("claim_id", "kind", "subject", "field", F.col("value").cast("double").alias("value")).join(told, "subject", "left")
    number, word = F.try_element_at("_number", F.col("field")), F.try_element_at("_word", F.col("field"))
    again = F.col("_number").isNotNull() & ((F.col("kind") == "entity") | number.isNotNull() | word.isNotNull())
    thing = F.coalesce(F.col("kind").isin("finding", "discrepancy", "entity"), F.lit(False))
    reason = F.when(thing, F.when(~again, "not_reproduced")).when(F.col("value").isNull() | number.isNull(), "inconclusive").when(~close(number, F.col("value"), *NEAR), "differs")
    return met.select("claim_id", reason.alias("reason")).select("claim_id", F.coalesce(F.col("reason") != "inconclusive", F.lit(False)).alias("refuted"), "reason")


def verdicts(claims: DataFrame, checked: DataFrame, refuted: DataFrame) -> DataFrame:
    """claim_id, supported, n_checks, failed (names, sorted), refuted: a claim is supported if it has checks, all passed, and nothing refutes it."""
    tally = checked.groupBy("claim_id").agg(F.count("*").alias("n_checks"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("failed"), F.bool_and("passed").alias("_all"))
    rows = claims.select("claim_id").join(tally, "claim_id", "left").join(refuted.select("claim_id", "refuted"), "claim_id", "left")
    no = F.coalesce("refuted", F.lit(False))
    return rows.select("claim_id", (F.coalesce("_all", F.lit(False)) & ~no).alias("supported"), F.coalesce("n_checks", F.lit(0).cast("long")).alias("n_checks"), F.coalesce("failed", F.array().cast("array<string>")).alias("failed"), no.alias("refuted"))
