"""Rules that compare claims with measures and give findings with severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.calendar import ag_year


def severity(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def extent_mismatch(claims: DataFrame, *, unit: str, area: str, extent: str, document: str, order: str, score: Column | None = None) -> DataFrame:
    """The claim closest to a unit's area, of single rows and of sums per document (rows first on a tie); those over 5 % off.

    A ratio over 10 or under 0.1 is a reading error. score: how surely a claim is linked to its unit (1 if not known)."""
    claims = claims.where(F.col(extent).isNotNull() & (F.col(extent) != 0))
    sure = claims.groupBy(unit).agg(F.min(F.coalesce(score if score is not None else F.lit(1.0), F.lit(1.0))).alias("_score"))
    rows = claims.select(unit, area, F.col(extent).alias("claimed"), F.lit(0).alias("kind"), F.col(order).alias("ord"))
    sums = claims.groupBy(unit, area, document).agg(F.sum(extent).alias("claimed"), F.count("*").alias("n"), F.min(order).alias("ord")).where("n > 1")
    options = rows.unionByName(sums.select(unit, area, "claimed", F.lit(1).alias("kind"), "ord"))
    best = options.groupBy(unit, area).agg(F.min(F.struct(F.round(F.abs(F.col("claimed") - F.col(area)), 6).alias("off"), "kind", "ord", "claimed")).alias("b"))
    off, share = F.col("b.claimed") - F.col(area), F.abs(F.col("b.claimed") - F.col(area)) / F.col(area)
    ratio = F.col("b.claimed") / F.col(area)
    out = best.where((F.col(area) > 0) & (share > 0.05))
    error = (ratio > 10) | (ratio < 0.1)
    sev = F.when(error, "low").when((F.abs(off) >= 1) | (share >= 0.5), "high").when(F.abs(off) >= 0.2, "medium").otherwise("low")
    return out.join(sure, unit).select(
        unit, F.col("b.claimed").alias("claimed"), off.alias("off"), F.when(F.col("b.kind") == 1, "doc_sum").otherwise("row").alias("basis"), F.when(error, "extraction_error").otherwise("mismatch").alias("category"),
        sev.alias("severity"), F.when(error, 0.8).otherwise(F.round(0.85 * F.col("_score"), 3)).alias("confidence"), F.lit("parcel").alias("evidence_level"),
    )


def modal_rate(rows: DataFrame, keys: Sequence[str], paid: Column, size: Column, unit: float = 1000.0, least: int = 3, part: float = 0.5) -> DataFrame:
    """keys, rate: the most frequent rate, rounded to `unit`, if max(least, part of the rows) are within 0.5 % of it; smaller on a tie.

    Rows that pay nothing have no rate, and a rate that rounds to 0 or less is none."""
    rated = rows.where((size > 0) & (paid != 0)).withColumn("_rate", paid / size).withColumn("_near", F.bround(F.col("_rate") / unit, 0) * unit)
    counts = rated.groupBy(*keys, "_near").agg(F.count("*").alias("_n"))
    mode = counts.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("_near")).alias("_m"))).alias("_b")).select(*keys, (-F.col("_b._m")).alias("rate"))
    support = rated.join(mode.where("rate > 0"), list(keys)).groupBy(*keys, "rate").agg(F.count_if(F.abs(F.col("_rate") - F.col("rate")) <= 0.005 * F.col("rate")).alias("support"), F.count("*").alias("rows"))
    return support.where(F.col("support") >= F.greatest(F.lit(float(least)), F.col("rows") * part)).select(*keys, "rate", "support", "rows")


def compensation_mismatch(rows: DataFrame, rates: DataFrame, keys: Sequence[str], paid: str, size: str, unit: str | None = None) -> DataFrame:
    """Rows whose payment differs from size times rate by more than 1 and half a percent of the rate.

    unit: column of the parcel that a row is linked to; rows without one are evidence of the block only."""
    due = F.col(size) * F.col("rate")
    joined = rows.where((F.col(size) != 0) & (F.col(paid) != 0)).join(rates.select(*keys, "rate"), list(keys)).withColumn("diff", F.col(paid) - due)
    off = joined.where(F.abs("diff") > 1 + 0.005 * F.col("rate"))
    error = (F.col(paid) > 10 * due) | (F.col(paid) * 10 < due)
    linked = F.col(unit).isNotNull() if unit else F.lit(True)
    return off.withColumns({
        "category": F.when(error, "extraction_error").otherwise("mismatch"), "severity": F.when(error, "low").otherwise(severity(F.abs("diff"), 1e5, 1e4)),
        "confidence": F.when(error, 0.8).when(linked, 0.7).otherwise(0.55), "evidence_level": F.when(linked, "parcel").otherwise("block"),
    })


def version_conflict(sources: DataFrame, *, place: str, value: str, kind: str, document: str, page: str, sanction: str = "GO", tolerance: float = 0.01, least: int = 5, near: float = 0.05) -> DataFrame:
    """place, values, low, high, spread, sanctioned, severity, confidence: totals of a place that differ between the pages that list many places.

    A page counts if at least `least` of its totals are within 5 % of the place's sanctioned total."""
    first = F.struct(document, page, value)
    go = sources.where(F.col(kind) == sanction).groupBy(place).agg(F.min_by(value, first).alias("_go"))
    known = sources.join(go, place, "left").withColumn("_near", F.coalesce(F.abs(F.col(value) - F.col("_go")) <= near * F.col("_go"), F.lit(False)))
    pages = known.groupBy(document, page).agg(F.count_if("_near").alias("_n")).where(F.col("_n") >= least)
    kept = known.join(pages.select(document, page), [document, page], "left_semi").withColumn("_v", F.round(value, 4))
    grouped = kept.groupBy(place).agg(F.array_sort(F.collect_set("_v")).alias("values"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.min_by(F.when(F.col(kind) == sanction, F.col(value)), F.when(F.col(kind) == sanction, first)).alias("sanctioned"))
    spread = F.round(F.col("high") - F.col("low"), 4)
    found = grouped.where((F.col("high") - F.col("low") > tolerance) & (F.size("values") > 1)).withColumn("spread", spread)
    return found.withColumns({"severity": F.when(F.col("spread") >= 1, "high").otherwise("medium"), "confidence": F.lit(0.8), "evidence_level": F.lit("village")})


#: Fixed value: mean days of a month.
MONTH = 30.44


def idle_bank(units: DataFrame, cleared: DataFrame, *, unit: str, group: Sequence[str], since: str, size: str, level: str, as_of: Column, months: float = 6, distances: Sequence[str] = ()) -> DataFrame:
    """group, idle_ha, n_parcels, oldest, months_since_oldest, evidence_level, severity, confidence, least of each distance in km.

    Units held for so many months that are not in `cleared` (unit: seen built or cleared since)."""
    held = units.where(F.datediff(as_of, F.col(since)) >= months * MONTH).join(cleared.select(unit).distinct(), unit, "left_anti")
    by_parcel = F.bool_or(F.col(level) == "parcel")
    found = held.groupBy(*group).agg(
        F.round(F.sum(F.coalesce(size, F.lit(0.0))), 4).alias("idle_ha"), F.count("*").alias("n_parcels"), F.min(since).alias("oldest"), F.when(by_parcel, "parcel").otherwise("block").alias("evidence_level"),
        *[F.round(F.min(d) / 1000, 3).alias(d) for d in distances],
    )
    return found.withColumns({"months_since_oldest": F.round(F.datediff(as_of, "oldest") / MONTH, 1), "severity": severity(F.col("idle_ha"), 20, 5), "confidence": F.when(F.col("evidence_level") == "parcel", 0.75).otherwise(0.6)})


def fmb_quality(overlaps: DataFrame, outside: DataFrame) -> DataFrame:
    """issue, uid, other, ha, severity, confidence of overlaps (uid_a, uid_b, overlap_ha; from 0.001 ha) and of what lies outside (uid, outside_ha)."""
    a = overlaps.where("overlap_ha >= 0.001").select(F.lit("OVERLAP").alias("issue"), F.col("uid_a").alias("uid"), F.col("uid_b").alias("other"), F.col("overlap_ha").alias("ha"), F.lit(0.95).alias("confidence"))
    b = outside.select(F.lit("OUTSIDE_SURVEY").alias("issue"), "uid", F.lit(None).cast(dict(overlaps.dtypes)["uid_b"]).alias("other"), F.col("outside_ha").alias("ha"), F.lit(0.9).alias("confidence"))
    return a.unionByName(b).withColumn("severity", severity(F.col("ha"), 0.25, 0.05))


def self_checks(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, check, outcome (pass, fail, skip): a condition that is null is skipped."""
    items = F.array(*[F.struct(F.lit(name).alias("check"), F.when(c.isNull(), "skip").when(c, "pass").otherwise("fail").alias("outcome")) for name, c in checks.items()])
    return rows.select(key, F.explode(items).alias("c")).select(key, "c.*")


def total_checks(rows: DataFrame, totals: DataFrame, key: str, value: str, total: str, tolerance: Column) -> DataFrame:
    """key, summed, total, outcome: whether rows add up to their printed total."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("summed"), F.count("*").alias("n"))
    joined = totals.join(sums, key, "left")
    outcome = F.when(F.col("summed").isNull() | F.col(total).isNull(), "skip").when(F.abs(F.col("summed") - F.col(total)) <= tolerance, "pass").otherwise("fail")
    return joined.select(key, "summed", total, outcome.alias("outcome"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """keys, outcome: only_left, only_right, differs (by more than the share) or agrees."""
    a = left.select(*keys, F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    outcome = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(F.abs(F.col("a") - F.col("b")) > share * F.abs("b"), "differs").otherwise("agrees")
    return a.join(b, list(keys), "full").select(*keys, outcome.alias("outcome"))


def possession(links: DataFrame, unit: str, day: str, kind: str) -> DataFrame:
    """unit, possession_date, level: earliest date; 'parcel' if any link isn't to a block."""
    return links.groupBy(unit).agg(F.min(day).alias("possession_date"), F.when(F.bool_or(F.col(kind) != "block"), "parcel").otherwise("block").alias("level"))


def post_possession(units: DataFrame, farmland_like: float = 0.7) -> DataFrame:
    """Findings from two difference-in-differences (vigour, plough: struct did, ci_lo, ci_hi, farmland_like_p): a drop, a farmed lead, or both.

    Units whose possession is shown neither for the parcel nor its block are left out. Farmland-likeness is that of the plough row, or
    where it has none (or 0) that of the vigour row."""
    base = F.when(F.col("possession_level") == "parcel", 0.7).otherwise(0.5)
    like = F.coalesce(F.nullif("plough.farmland_like_p", F.lit(0.0)), F.nullif("vigour.farmland_like_p", F.lit(0.0)), F.lit(0.0))
    one = lambda name, sev, p: F.struct(F.lit(name).alias("finding"), F.lit(sev).alias("severity"), F.round(p, 3).alias("confidence"))
    drop = F.when(F.col("vigour.ci_hi") < 0, one("drop", "medium", base))
    lead = F.when((F.col("plough.ci_lo") > 0) & (like >= farmland_like), one("farmed_lead", "low", base - 0.15))
    shown = units.where(F.col("possession_level").isin("parcel", "block"))
    return shown.select("parcel_uid", F.col("possession_level").alias("evidence_level"), F.explode(F.array_compact(F.array(drop, lead))).alias("f")).select("parcel_uid", "evidence_level", "f.*")


def classification_conflict(units: DataFrame, years: int = 3, need: int = 2) -> DataFrame:
    """Records against the seasons (array of ag_year, season, state) of the agricultural years before the notice's: DRY with irrigated_multi in two
    years or more, WET with none (also without any season), PORAMBOKE with a crop in two seasons."""
    year = ag_year(F.col("notice"))
    inside = F.filter("seasons", lambda s: (s["ag_year"] >= year - years) & (s["ag_year"] < year))
    multi = F.array_sort(F.array_distinct(F.transform(F.filter(inside, lambda s: s["state"] == "irrigated_multi"), lambda s: s["ag_year"])))
    crops = F.size(F.array_distinct(F.transform(F.filter(inside, lambda s: s["state"].isin("cropped", "irrigated_multi")), lambda s: F.struct(s["ag_year"], s["season"]))))
    known = units.where("notice is not null").withColumn("seasons", F.coalesce("seasons", F.array().cast(dict(units.dtypes)["seasons"])))
    counted = known.select("parcel_uid", "classification", multi.alias("irrigated_years"), crops.alias("crop_seasons"))
    n = F.size("irrigated_years")
    rule = (
        F.when((F.col("classification") == "DRY") & (n >= need), "dry_but_irrigated").when((F.col("classification") == "WET") & (n == 0), "wet_but_never")
        .when((F.col("classification") == "PORAMBOKE") & (F.col("crop_seasons") >= 2), "poramboke_cropped")
    )
    found = counted.withColumn("finding", rule).where("finding is not null")
    return found.withColumns({"severity": F.when(n >= years, "medium").otherwise("low"), "confidence": F.lit(0.55), "evidence_level": F.lit("parcel")})


def keyed_audit(findings: DataFrame, category: str, key: str, n: int, seed: str) -> DataFrame:
    """n findings of each category by md5(key | seed), for recomputation."""
    w = Window.partitionBy(category).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|" + seed))), key)
    return findings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
