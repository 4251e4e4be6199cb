"""Tiered record linkage of a record's references to units within a village.

Every reference becomes one row a key it may be known by; every unit one row a key. They meet tier by tier in equi-joins on village
and key, and later tiers are only asked for what earlier ones didn't find. Of units that look alike the three with the least uid go along, a whole
survey is one link until the end. Scores are adjusted by context, the best is
accepted if it is good enough and far enough ahead. A record of several references is a list; one without a village, or whose
village was only guessed, may be resolved by the one other village that has its reference in the same unit and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.normalise import norm_token, ocr_variants, parse_refs
from evidra.sources.checkpoints import cut

#: Tier scores, acceptance, context adjustments, candidates that are kept.
EXACT, NORMAL, PARENT_ONE, SURVEY_LEVEL, PREFIX, SWAP_ONE, SWAP_TWO = 1.0, 0.95, 0.90, 0.85, 0.80, 0.65, 0.45
ACCEPT, MARGIN = 0.80, 0.10
BLOCK_SAME, BLOCK_OTHER, EXTENT_NEAR, EXTENT_FAR, HEADER_ONLY, HEADER_CONFLICT, RERESOLVED = 0.05, -0.10, 0.05, -0.10, -0.05, -0.05, -0.05
TOP = 3
#: Fixed value: characters of a part by which longer ones that begin with it are looked up.
HEAD = 8
CONTEXT = ("block", "unit", "extent", "from_header", "header_conflict", "scheme_header")


def prepared(units: DataFrame) -> DataFrame:
    """units (uid, village, code, block, unit, area) with survey and sub of their code."""
    return units.withColumns({"survey": norm_token(F.substring_index("code", "/", 1)), "sub": norm_token(F.when(F.contains("code", F.lit("/")), F.regexp_replace("code", "^[^/]*/", "")))})


def members(records: DataFrame) -> DataFrame:
    """One row a reference of each record: id, i, n, survey, sub, village and context."""
    refs = records.select("id", "village", *CONTEXT, parse_refs(F.col("survey_no"), F.col("sub_div")).alias("_r"))
    return refs.select("*", F.size("_r").alias("n"), F.posexplode("_r").alias("i", "_m")).select("*", "_m.survey", "_m.sub").drop("_r", "_m")


def key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *parts)


def indexed(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What references are looked up in: the TOP units (least uid) of all that look alike, as no more of them can be among a reference's best; and of every
    survey its TOP units with `_units`, the number of all of it, and `_sum`, their area."""
    few = lambda *by: units.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("uid"))).where(F.col("_k") <= TOP).drop("_k")
    about = ("village", "survey", "uid", F.col("block").alias("u_block"), F.col("unit").alias("u_unit"), "area")
    whole = units.groupBy("village", "survey").agg(F.count("*").alias("_units"), F.sum("area").alias("_sum"))
    alike = few("village", "code", "survey", "sub", "block", "unit", "area").select(*about, "code", F.col("sub").alias("u_sub"))
    return cut(alike), cut(few("village", "survey").select(*about).join(whole, ["village", "survey"]))


def candidates(refs: DataFrame, alike: DataFrame, surveys: DataFrame) -> DataFrame:
    """id, i, uid, tier, base, u_block, u_unit, area, _n, _total of the least tier that finds a unit for each reference, in one village; alike, surveys: see indexed.

    A tier is only asked for references that none before has found. A whole survey is not spread: its first units stand for all `_n`."""
    whole = F.col("sub") == ""
    readings = lambda c: ocr_variants(F.col(c))
    both = F.filter(F.flatten(F.transform(readings("survey"), lambda a: F.transform(readings("sub"), lambda b: F.struct(a["variant"].alias("s"), b["variant"].alias("d"), (a["swaps"] + b["swaps"]).alias("swaps"))))), lambda v: v["swaps"].between(1, 2))
    about, one = ("uid", "u_block", "u_unit", "area"), F.lit(None).cast("long")
    shaped = lambda df, tier, base, n=one, total=one.cast("double"): df.select("id", "i", "uid", tier.alias("tier"), base.alias("base"), "u_block", "u_unit", "area", n.alias("_n"), total.alias("_total"))

    code = F.when(whole, F.col("survey")).otherwise(F.concat_ws("/", "survey", "sub"))
    ways = F.array(*[F.struct(F.lit(rank).alias("rank"), k.alias("key")) for rank, k in enumerate((key("E", code), key("K", F.col("survey"), F.col("sub"))))])
    asked = refs.select("id", "i", "village", F.inline(ways))
    exact = asked.join(alike.select(*about, "village", F.explode(F.array(key("E", F.col("code")), key("K", F.col("survey"), F.col("u_sub")))).alias("key")), ["village", "key"])
    exact = exact.withColumn("_least", F.min("rank").over(Window.partitionBy("id", "i"))).where("rank = _least")
    exact = cut(shaped(exact, F.when(F.col("rank") == 0, "exact").otherwise("normalised"), F.when(F.col("rank") == 0, EXACT).otherwise(NORMAL)))
    rest = cut(refs.join(exact.select("id", "i"), ["id", "i"], "left_anti").select("id", "i", "village", "survey", "sub"))

    several = F.col("_units") > 1
    surveyed = cut(shaped(rest.where(whole).join(surveys, ["village", "survey"]), F.when(several, "survey_level").otherwise("parent_survey"), F.when(several, SURVEY_LEVEL).otherwise(PARENT_ONE), F.col("_units"), F.col("_sum")))
    heads = alike.where("u_sub <> ''").select(*about, "village", "survey", "u_sub", F.explode(F.sequence(F.lit(1), F.least(F.length("u_sub"), F.lit(HEAD)))).alias("_l"))
    heads = heads.select(*about, "village", "survey", "u_sub", F.substring(F.col("u_sub"), F.lit(1), F.col("_l")).alias("head"))
    begun = rest.where(~whole).withColumn("head", F.substring("sub", 1, HEAD)).join(heads, ["village", "survey", "head"]).where(F.startswith("u_sub", F.col("sub")) & (F.col("u_sub") != F.col("sub")))
    begun = cut(shaped(begun, F.lit("subdiv_prefix"), F.lit(PREFIX)))

    left = rest.join(surveyed.select("id", "i").unionByName(begun.select("id", "i")), ["id", "i"], "left_anti").select("id", "i", "village", F.explode(both).alias("v")).select("id", "i", "village", "v.swaps", key("K", F.col("v.s"), F.col("v.d")).alias("key"))
    read = left.join(alike.select(*about, "village", key("K", F.col("survey"), F.col("u_sub")).alias("key")), ["village", "key"])
    read = read.groupBy("id", "i", *about).agg(F.max(F.when(F.col("swaps") == 1, SWAP_ONE).otherwise(SWAP_TWO)).alias("base"))
    return exact.unionByName(surveyed).unionByName(begun).unionByName(shaped(read, F.lit("ocr"), F.col("base")))


def context(tier: Column, area: Column, again: bool) -> list[tuple[Column, float, str]]:
    """(condition, change of the score, reason) of everything around a candidate; block and unit don't count for a whole survey."""
    same = (F.col("block") == F.col("u_block")) & (F.col("unit").isNull() | F.col("u_unit").isNull() | (F.col("unit") == F.col("u_unit")))
    told = F.col("block").isNotNull() & F.col("u_block").isNotNull() & (tier != "survey_level")
    sized = (F.coalesce("extent", F.lit(0.0)) != 0) & (F.coalesce(area, F.lit(0.0)) != 0)
    near = F.abs(F.col("extent") - area) / area <= 0.10
    return [
        (told & same, BLOCK_SAME, "block_agree"), (told & ~same, BLOCK_OTHER, "block_disagree"), (sized & near, EXTENT_NEAR, "extent_agree"), (sized & ~near & (F.col("extent") > 1.5 * area + 0.05), EXTENT_FAR, "extent_far"),
        (F.col("from_header"), HEADER_ONLY, "village_from_header"), (F.col("header_conflict"), HEADER_CONFLICT, "row_village_differs_from_header"), (F.lit(again), RERESOLVED, "village_reresolved"),
    ]


def resolve(refs: DataFrame, alike: DataFrame, surveys: DataFrame, again: bool = False) -> DataFrame:
    """id, i, status, links (uid, kind, score, n; a whole survey is one link without uid, but with its village and survey), candidates (the three best, with reasons) of each reference."""
    found = candidates(refs, alike, surveys).join(refs.select("id", "i", "village", "survey", *CONTEXT), ["id", "i"])
    w = Window.partitionBy("id", "i")
    area = F.when(F.col("tier") == "survey_level", F.col("_total")).otherwise(F.col("area"))
    found = found.withColumn("_area", area)
    rules = [(F.coalesce(c, F.lit(False)), change, name) for c, change, name in context(F.col("tier"), F.col("_area"), again)]
    score = F.col("base") + sum((F.when(c, change).otherwise(0.0) for c, change, _ in rules), F.lit(0.0))
    reasons = F.array_compact(F.array(F.col("tier"), *[F.when(c, F.lit(name)) for c, _, name in rules]))
    scored = found.select("id", "i", "village", "survey", "_n", "uid", "tier", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6).alias("score"), reasons.alias("reasons"))
    ranked = scored.withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "uid")))
    level = F.bool_or(F.col("tier") == "survey_level")
    folded = ranked.groupBy("id", "i").agg(
        level.alias("_level"), F.max(F.when(F.col("_k") == 1, F.col("score"))).alias("_top"), F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("score"))), F.lit(0.0)).alias("_next"), F.min(F.when(F.col("_k") == 1, F.col("uid"))).alias("_uid"),
        F.max(F.when(F.col("_k") == 1, F.struct("village", "survey", F.col("_n").alias("n")))).alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("_k") <= TOP, F.struct("_k", "uid", "score", "tier", "reasons")))).alias("_c"),
    )
    sure = F.col("_top") >= ACCEPT
    clear = sure & (F.round(F.col("_top") - F.col("_next"), 6) >= MARGIN)
    status = F.when(F.col("_level"), F.when(sure, "survey_level").otherwise("ambiguous")).when(clear, "accepted").otherwise("ambiguous")
    kind = dict(alike.dtypes)["uid"]
    none = F.array().cast(f"array<struct<uid:{kind},kind:string,score:double,village:string,survey:string,n:bigint>>")
    one = lambda uid, name, village, survey, n: F.array(F.struct(uid.cast(kind).alias("uid"), F.lit(name).alias("kind"), F.col("_top").alias("score"), village.cast("string").alias("village"), survey.cast("string").alias("survey"), n.cast("long").alias("n")))
    nothing = F.lit(None)
    links = F.when(status == "survey_level", one(nothing, "survey_level", F.col("_all.village"), F.col("_all.survey"), F.col("_all.n"))).when(status == "accepted", one(F.col("_uid"), "parcel", nothing, nothing, F.lit(1))).otherwise(none)
    out = folded.select("id", "i", status.alias("status"), links.alias("links"), F.transform("_c", lambda c: F.struct(c["uid"].alias("uid"), c["score"].alias("score"), c["tier"].alias("tier"), c["reasons"].alias("reasons"))).alias("candidates"))
    return refs.select("id", "i").join(out, ["id", "i"], "left").withColumns({"status": F.coalesce("status", F.lit("no_candidate")), "links": F.coalesce("links", none)})


def outcomes(results: DataFrame) -> DataFrame:
    """id, status, uid, score, links, candidates of each record from those of its references."""
    ok = F.col("status").isin("accepted", "survey_level")
    folded = results.groupBy("id").agg(
        F.count("*").alias("_n"), F.count_if(ok).alias("_ok"), F.bool_or(F.size("candidates") > 0).alias("_any"), F.min("status").alias("_one"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "links"))), lambda x: x["links"])).alias("_links"), F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce(F.size("candidates"), F.lit(0)).alias("n"), "candidates"))), lambda x: x["candidates"]).alias("candidates"),
    )
    alone = F.col("_n") == 1
    lists = F.when(F.col("_ok") == F.col("_n"), "list").when(F.col("_ok") > 0, "list_partial").when(F.col("_any"), "ambiguous").otherwise("no_candidate")
    links = F.transform("_links", lambda x: x.withField("kind", F.when(~alone & (x["kind"] == "parcel"), "list_member").otherwise(x["kind"])))
    top = F.try_element_at(F.element_at("candidates", 1), F.lit(1))["score"]
    score = F.when(alone, top).otherwise(F.array_min(F.transform("_links", lambda x: x["score"])))
    return folded.select("id", F.when(alone, F.col("_one")).otherwise(lists).alias("status"), F.when(alone & (F.col("_one") == "accepted"), F.try_element_at("_links", F.lit(1))["uid"]).alias("uid"), score.alias("score"), links.alias("links"), "candidates")


def other_village(refs: DataFrame, units: DataFrame) -> DataFrame:
    """id, village: the one other village that has a reference of the record in its block (and unit, if told)."""
    k = F.when(F.col("sub") == "", key("S", F.col("survey"))).otherwise(key("K", F.col("survey"), F.col("sub")))
    asked = refs.where("block is not null").select("id", F.col("village").alias("_old"), "block", F.col("unit").alias("_unit"), k.alias("key"))
    held = units.select("village", "block", F.col("unit").alias("_u"), F.explode(F.array(key("K", F.col("survey"), F.col("sub")), key("S", F.col("survey")))).alias("key"))
    met = asked.join(held.distinct(), ["key", "block"]).where("(_old is null or village <> _old) and (_unit is null or _u = _unit)")
    return met.groupBy("id").agg(F.count_distinct("village").alias("_n"), F.min("village").alias("village")).where("_n = 1").drop("_n")


def spread(found: DataFrame, units: DataFrame) -> DataFrame:
    """id, links (uid, kind, score): a whole survey's link becomes one a unit of it, by uid."""
    uids = units.groupBy("village", "survey").agg(F.array_sort(F.collect_list("uid")).alias("uids"))
    each = found.select("id", F.posexplode("links").alias("pos", "l")).select("id", "pos", "l", "l.village", "l.survey").join(uids, ["village", "survey"], "left")
    of = lambda uid: F.struct(uid.alias("uid"), F.col("l.kind").alias("kind"), F.col("l.score").alias("score"))
    each = each.select("id", "pos", F.when(F.col("village").isNull(), F.array(of(F.col("l.uid")))).otherwise(F.transform("uids", of)).alias("links"))
    return each.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "links"))), lambda x: x["links"])).alias("links"))


def link(records: DataFrame, units: DataFrame, schemes: Sequence[str] = ()) -> DataFrame:
    """id, village (used), status, uid, score, links, n_links (their number), candidates of every record (id, village, survey_no, sub_div and CONTEXT).

    status: accepted, survey_level, list, list_partial, ambiguous, no_candidate, no_ref or no_village. Only a village that is unknown, a
    scheme's name or taken from a header is put aside for another. Ties go to the smaller uid."""
    units = cut(prepared(units))
    index = indexed(units)
    known = units.select("village").distinct().withColumn("_known", F.lit(True))
    every = records.join(known, "village", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    refs = cut(members(every))  # each step is used several times
    flag = every.select("id", "_known")
    first = cut(outcomes(resolve(refs.join(flag, "id").where("_known").drop("_known"), *index)))
    loose = ~F.col("_known") | F.col("village").isin(*schemes) | F.coalesce("scheme_header", F.lit(False)) | F.coalesce("from_header", F.lit(False))
    missed = every.where(loose).join(first.where("status <> 'no_candidate'").select("id"), "id", "left_anti").select("id", F.when(F.col("_known"), F.col("village")).alias("_v"))
    moved = cut(refs.join(missed, "id").withColumn("village", F.col("_v")).drop("_v"))
    found = cut(other_village(moved, units))
    second = cut(outcomes(resolve(moved.drop("village").join(found, "id"), *index, again=True)).where("status <> 'no_candidate'").join(found, "id"))
    kept = first.join(second.select("id"), "id", "left_anti").join(every.select("id", "village"), "id")
    done = kept.unionByName(second)
    rest = every.join(done.select("id"), "id", "left_anti")
    none = F.size(parse_refs(F.col("survey_no"), F.col("sub_div"))) == 0
    left = rest.select("id", "village", F.when(none, "no_ref").otherwise("no_village").alias("status"))
    every = done.unionByName(left, allowMissingColumns=True)
    total = F.aggregate("links", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    shown = every.select("id", "village", "status", "uid", "score", total.alias("n_links"), "candidates").join(spread(done, units), "id", "left")
    none = F.array().cast(f"array<struct<uid:{dict(units.dtypes)['uid']},kind:string,score:double>>")
    return shown.select("id", "village", "status", "uid", "score", F.when(F.col("n_links").isNotNull(), F.coalesce("links", none)).alias("links"), "n_links", "candidates")


def match_rates(links: DataFrame, by: str) -> DataFrame:
    """by, rows, linked, ambiguous, rate (4 digits)."""
    good = F.count_if(F.col("status").isin("accepted", "survey_level", "list", "list_partial"))
    return links.groupBy(by).agg(F.count("*").alias("rows"), good.alias("linked"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.round(good / F.count("*"), 4).alias("rate"))
