"""Findings about land records over the test tables, which stand in for parcels, documents and seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import calendar, names, normalise
from evidra.operators import evidence, findings, lifecycle, router
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()

AG_YEAR = "cast(case when month({0}) >= 6 then year({0}) else year({0}) - 1 end as integer)"


@query(f"""with s as (select o_custkey as id, {AG_YEAR.format("d")} as y, case when month(d) between 6 and 9 then 'kharif' when month(d) between 3 and 5 then 'summer' else 'rabi' end as season, case substr(o_orderpriority, 1, 1) when '1' then 'irrigated_multi' when '2' then 'cropped' else 'bare_fallow' end as st
from (select *, cast(o_orderdate as date) as d from orders)), u as (select c_custkey as id, case c_custkey % 3 when 0 then 'DRY' when 1 then 'WET' else 'PORAMBOKE' end as cls, case when c_custkey % 11 = 0 then null else date '1998-01-01' + cast(c_custkey % 700 as integer) end as notice from customer),
j as (select u.id, cls, y, season, st from u left join s on s.id = u.id and y between {AG_YEAR.format("notice")} - 3 and {AG_YEAR.format("notice")} - 1 where notice is not null),
a as (select id, cls, coalesce(list_sort(list(distinct y) filter (st = 'irrigated_multi')), []) as irrigated_years, cast(count(distinct (y, season)) filter (st in ('irrigated_multi', 'cropped')) as integer) as crop_seasons from j group by 1, 2),
f as (select *, case when cls = 'DRY' and len(irrigated_years) >= 2 then 'dry_but_irrigated' when cls = 'WET' and len(irrigated_years) = 0 then 'wet_but_never' when cls = 'PORAMBOKE' and crop_seasons >= 2 then 'poramboke_cropped' end as finding from a)
select id as parcel_uid, cls as classification, irrigated_years, crop_seasons, finding, case when len(irrigated_years) >= 3 then 'medium' else 'low' end as severity, 0.55::double as confidence, 'parcel' as evidence_level from f where finding is not null""")
def q111_classification_conflict(spark, sf_dir):
    day, kind, k = F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1), F.col("c_custkey")
    state = F.when(kind == "1", "irrigated_multi").when(kind == "2", "cropped").otherwise("bare_fallow")
    season = F.struct(calendar.ag_year(day).alias("ag_year"), calendar.season(day).alias("season"), state.alias("state"))
    seasons = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), season.alias("s")).distinct().groupBy("c_custkey").agg(F.collect_list("s").alias("seasons"))  # a few dozen seasons a parcel
    units = table(spark, sf_dir, "customer").join(seasons, "c_custkey", "left").select(
        k.alias("parcel_uid"), F.when(k % 3 == 0, "DRY").when(k % 3 == 1, "WET").otherwise("PORAMBOKE").alias("classification"), F.when(k % 11 != 0, F.date_add(F.lit("1998-01-01").cast("date"), (k % 700).cast("int"))).alias("notice"), "seasons",
    )
    return findings.classification_conflict(units)


@query("""with p as (select p_partkey as k, case p_partkey % 5 when 0 then 'none' when 1 then 'block' else 'parcel' end as lvl, p_size / 25 - 1.2 as vhi, p_retailprice / 2000 - 0.5 as plo, case p_partkey % 4 when 0 then null when 1 then 0 else (p_partkey % 10) / 10 end as pf, (p_partkey % 9) / 8 as vf from part),
q as (select *, case when lvl = 'parcel' then 0.7 else 0.5 end as base, coalesce(nullif(pf, 0), nullif(vf, 0), 0) as f from p where lvl <> 'none')
select k as parcel_uid, lvl as evidence_level, 'drop' as finding, 'medium' as severity, base::double as confidence from q where vhi < 0 union all select k, lvl, 'farmed_lead', 'low', round(base - 0.15, 3)::double from q where plo > 0 and f >= 0.7""")
def q112_post_possession(spark, sf_dir):
    k = F.col("p_partkey")
    row = lambda lo, hi, like: F.struct(F.lit(0.0).alias("did"), lo.cast("double").alias("ci_lo"), hi.cast("double").alias("ci_hi"), like.cast("double").alias("farmland_like_p"))
    level = F.when(k % 5 == 0, "none").when(k % 5 == 1, "block").otherwise("parcel")
    plough = F.when(k % 4 == 0, None).when(k % 4 == 1, 0.0).otherwise((k % 10) / 10)
    units = table(spark, sf_dir, "part").select(k.alias("parcel_uid"), level.alias("possession_level"), row(F.lit(-9), F.col("p_size") / 25 - 1.2, (k % 9) / 8).alias("vigour"), row(F.col("p_retailprice") / 2000 - 0.5, F.lit(9), plough).alias("plough"))
    return findings.post_possession(units)


@query("""with o as (select l_partkey as a, l_suppkey as b, l_tax / 10 as ha from lineitem where l_linenumber = 1), u as (select s_suppkey as uid, s_acctbal / 20000 as ha from supplier where s_acctbal > 0),
f as (select 'OVERLAP' as issue, a as uid, b as other, ha, 0.95::double as confidence from o where ha >= 0.001 union all select 'OUTSIDE_SURVEY', uid, null, ha, 0.9 from u)
select issue, uid, other, round(ha, 6) as ha, confidence, case when ha >= 0.25 then 'high' when ha >= 0.05 then 'medium' else 'low' end as severity from f""")
def q113_fmb_quality(spark, sf_dir):
    over = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("uid_a"), F.col("l_suppkey").alias("uid_b"), (F.col("l_tax") / 10).alias("overlap_ha"))
    outside = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("uid"), (F.col("s_acctbal") / 20000).alias("outside_ha"))
    return findings.fmb_quality(over, outside).withColumn("ha", F.round("ha", 6))


#: Spellings of three villages.
ALIASES = {"greenfield": "Greenfield", "greenfeeld": "Greenfield", "stonebridge": "Stonebridge", "பேரூரணி": "Peroorani"}


@query("""select c_custkey, case c_custkey % 7 when 0 then 'Greenfield' when 1 then 'Greenfield' when 2 then 'Stonebridge' when 3 then 'Stonebridge' when 4 then null when 5 then null else 'Peroorani' end as village,
case c_custkey % 7 when 0 then 'Greenfield' when 1 then 'Greenfield' when 2 then 'Stonebridge' end as mentioned from customer""")
def q114_villages(spark, sf_dir):
    k = F.col("c_custkey") % 7
    texts = ["GREEN FIELD village", "survey of Greenfeeld, unit 5", "Stone-Bridge.", "Stonebrige", "Nowhere", "", "பேருரணி கிராமம்"]
    raw = F.element_at(F.array(*[F.lit(t) for t in texts]), k.cast("int") + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", names.village(raw, ALIASES).alias("village"), names.village_in_text(raw, ALIASES).alias("mentioned"))


@query("""select c_custkey, case c_custkey % 8 when 0 then 'DRY' when 1 then 'WET' when 2 then 'PORAMBOKE' when 3 then 'OTHER' when 4 then 'PORAMBOKE' when 5 then null when 6 then null else 'DRY' end as class from customer""")
def q115_classification(spark, sf_dir):
    texts = ["Patta (Dry)", "WET land", "Govt. Poramboke", "house-site", "porambke", "nil", "qqqq", "புஞ்சை"]
    raw = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % 8).cast("int") + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", names.classification(raw).alias("class"))


@query("""select c_custkey, 'Customer ' || c_custkey as name, case c_custkey % 3 when 0 then 'father' when 1 then 'husband' end as relation, case when c_custkey % 3 < 2 then 'Nation ' || c_nationkey end as relation_name, case when c_custkey % 2 = 0 then 'Thiru' end as honorific, c_custkey % 5 = 0 as legal_heirs,
'Customer ' || c_custkey || ' ; Second Owner' as display from customer""")
def q116_owners(spark, sf_dir):
    k, nation = F.col("c_custkey"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))
    who = F.concat(F.lit("Customer "), k.cast("string"))
    related = F.when(k % 3 == 0, F.concat(F.lit(" S/o. "), nation)).when(k % 3 == 1, F.concat(F.lit(", W/o "), nation)).otherwise(F.lit(""))
    raw = F.concat(F.lit("1. "), F.when(k % 2 == 0, "Thiru. ").otherwise(""), who, related, F.when(k % 5 == 0, " legal heirs").otherwise(""))
    two = F.concat(F.lit("1. "), who, F.lit("\n2. Second Owner"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.owner(raw).alias("o"), names.owner_display(two).alias("display")).select("c_custkey", "o.name", "o.relation", "o.relation_name", "o.honorific", "o.legal_heirs", "display")


@query("""with p as (select p_partkey, p_size as z, p_partkey % 90 as k from part) select p_partkey, cast(z * 100000 + 5 * 1000 + 3 * 100 + 21 as bigint) as number, round(k + 0.25 + 0.005, 4)::double as ha, round(z + 0.5, 4)::double as cents from p""")
def q117_number_words(spark, sf_dir):
    size, k = F.col("p_size"), (F.col("p_partkey") % 90).cast("string")
    ones = F.element_at(F.array(*[F.lit(w) for w in normalise.UNITS]), (size % 10) + 1)
    tens = F.element_at(F.array(*[F.lit(w) for w in ("", "ten", "twenty", "thirty", "forty", "fifty")]), F.floor(size / 10).cast("int") + 1)
    teens = F.element_at(F.array(*[F.lit(w) for w in normalise.UNITS]), F.least(size, F.lit(19)) + 1)
    lakhs = F.when(size < 20, teens).otherwise(F.concat_ws(" ", tens, F.when(size % 10 > 0, ones)))
    words = F.concat(F.lit("Rupees "), lakhs, F.lit(" lakhs five thousand three hundred and twenty-one only"))
    return table(spark, sf_dir, "part").select("p_partkey", normalise.number_words(words).alias("number"), normalise.extent_ha(F.concat(k, F.lit(".25.5 ஹெக்டேர் (9 ac)"))).alias("ha"), normalise.cents(F.concat(size.cast("string"), F.lit("½ cents"))).alias("cents"))


@query("""with f as (select l_partkey as parcel_uid, l_orderkey * 10 + l_linenumber as key, case l_linenumber % 3 when 0 then 'PV1' when 1 then 'PV3' else 'EXTENT' end as category, case l_returnflag when 'A' then 'high' when 'N' then 'low' else 'medium' end as severity, l_discount * 8 as confidence, l_linestatus = 'O' as op from lineitem)
select category, severity, count(*) as n, count(distinct parcel_uid) as parcels, round(avg(confidence), 4) as confidence from f where op group by rollup (category, severity) having category is not null""")
def q118_finding_summary(spark, sf_dir):
    return evidence.finding_summary(finding_rows(spark, sf_dir))


def finding_rows(spark, sf_dir):
    kind = F.col("l_linenumber") % 3
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("parcel_uid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.when(kind == 0, "PV1").when(kind == 1, "PV3").otherwise("EXTENT").alias("category"),
        F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "low").otherwise("medium").alias("severity"), (F.col("l_discount") * 8).alias("confidence"), F.when(F.col("l_linestatus") == "O", "open").otherwise("closed").alias("status"), F.to_date("l_shipdate").alias("day"),
    )


@query("""with f as (select l_partkey as parcel_uid, l_orderkey * 10 + l_linenumber as key, case l_linenumber % 3 when 0 then 'PV1' when 1 then 'PV3' else 'EXTENT' end as category, case l_returnflag when 'A' then 'high' when 'N' then 'low' else 'medium' end as severity, l_discount * 8 as confidence from lineitem where l_linestatus = 'O')
select parcel_uid, key, severity, confidence from f where category = 'PV3' and confidence >= 0.3 order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, confidence desc, key limit 50""")
def q119_findings_query(spark, sf_dir):
    return evidence.findings_query(finding_rows(spark, sf_dir), category="pv3", least=0.3, limit=50).select("parcel_uid", "key", "severity", "confidence")


STATE = "case substr(o_orderpriority, 1, 1) when '1' then 'irrigated_multi' when '2' then 'cropped' when '3' then 'insufficient_data' else 'bare_fallow' end"
SEASON_ROWS = f"s as (select o_custkey as parcel_uid, {AG_YEAR.format('d')} as ag_year, case when month(d) between 6 and 9 then 'kharif' when month(d) between 3 and 5 then 'summer' else 'rabi' end as season, {STATE} as state, o_totalprice as p from (select *, cast(o_orderdate as date) as d from orders))"


def season_rows(spark, sf_dir):
    day, kind = F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    state = F.when(kind == "1", "irrigated_multi").when(kind == "2", "cropped").when(kind == "3", "insufficient_data").otherwise("bare_fallow")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parcel_uid"), calendar.ag_year(day).alias("ag_year"), calendar.season(day).alias("season"), state.alias("state"), F.col("o_totalprice").alias("p"))


@query(f"""with {SEASON_ROWS}, b as (select parcel_uid, ag_year, season, arg_max(state, (p, state)) as state from s group by all)
select parcel_uid, ag_year, max(state) filter (season = 'kharif') as kharif, max(state) filter (season = 'rabi') as rabi, max(state) filter (season = 'summer') as summer from b group by 1, 2""")
def q120_season_table(spark, sf_dir):
    return evidence.season_table(season_rows(spark, sf_dir))


@query(f"""with {SEASON_ROWS} select ag_year, season, count(*) as parcels, count(*) filter (state in ('cropped', 'irrigated_multi')) as cropped, round(count(*) filter (state in ('cropped', 'irrigated_multi')) / count(*), 4) as share from s where state <> 'insufficient_data' group by 1, 2""")
def q121_crop_presence(spark, sf_dir):
    return evidence.crop_presence(season_rows(spark, sf_dir))


@query("""with e as (select user_id as parcel_uid, cast(ts as date) as day, 'event' as kind, event_type as label from events where event_type in ('signup', 'purchase')),
s as (select distinct user_id as parcel_uid, date '2024-02-29' as day, 'season' as kind, 'rabi cropped' as label from events), f as (select user_id, cast(ts as date), 'finding', 'LARGE' from events where value > 200),
a as (select * from e union all select * from s union all select * from f) select parcel_uid, day, kind, label, row_number() over (partition by parcel_uid order by day, kind, label) as place from a""")
def q122_parcel_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("parcel_uid"), F.to_date("ts").alias("day"), F.col("event_type").alias("stage"), "value")
    seasons = rows.select("parcel_uid").distinct().select("parcel_uid", calendar.season_window(F.lit(2023), F.lit("rabi"))["end"].alias("end"), F.lit("rabi").alias("season"), F.lit("cropped").alias("state"))
    return evidence.parcel_timeline(rows.where("stage in ('signup', 'purchase')"), seasons, rows.where("value > 200").select("parcel_uid", "day", F.lit("LARGE").alias("category")))


@query("""with o as (select user_id as parcel_uid, cast(ts as date) as day, value, event_type <> 'error' as good from events) select parcel_uid, count(*) as n, count(*) filter (good) as n_usable, min(day) as first, max(day) as last, round(avg(value) filter (good), 6) as mean, arg_max(day, (value, -epoch(day))) filter (good) as best_day from o group by 1""")
def q123_satellite_summary(spark, sf_dir):
    return evidence.satellite_summary(observations(spark, sf_dir), "value")


def observations(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("parcel_uid"), F.to_date("ts").alias("day"), "value", (F.col("event_type") != "error").alias("usable"))


@query("""with d as (select user_id as parcel_uid, cast(ts as date) as day, avg(value) as v, count(*) as n from events where event_type <> 'error' group by 1, 2) select parcel_uid, day, round(v, 6) as value, n, round(avg(v) over (partition by parcel_uid order by day range between interval 6 days preceding and current row), 6) as recent from d""")
def q124_satellite_timeseries(spark, sf_dir):
    found = evidence.satellite_timeseries(observations(spark, sf_dir), "value", 7)
    return found.withColumns({"value": F.round("value", 6), "recent": F.round("recent", 6)})


@query("""with m as (select distinct user_id, cast(ts as date) as day from events where event_type = 'purchase'), p as (select distinct user_id, cast(ts as date) as on_day from events where event_type = 'signup'),
j as (select p.user_id, on_day, day, row_number() over (partition by p.user_id, on_day order by abs(day - on_day), day) as r from p left join m on m.user_id = p.user_id and abs(day - on_day) <= 5) select user_id, on_day, day as found from j where r = 1""")
def q125_nearest_in_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    pick = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", "day").distinct()
    return evidence.nearest_in_time(pick("signup").withColumnRenamed("day", "on_day"), pick("purchase"), "user_id", "on_day", "day", 5)


STAGES = ["SEC_3_1", "SEC_3_2", "EXEMPTION", "AWARD", "PAYMENT", "POSSESSION", "MUTATION"]


@query("""with g as (select unnest(['SEC_3_1', 'SEC_3_2', 'EXEMPTION', 'AWARD', 'PAYMENT', 'POSSESSION', 'MUTATION']) as stage, unnest(generate_series(1, 7)) as ord),
e as (select l_partkey as uid, g.stage, g.ord, cast(l_shipdate as date) as day, case l_returnflag when 'A' then 'parcel' when 'N' then 'block_level' else 'survey_level' end as k from lineitem join g on g.ord = l_linenumber),
f as (select uid, max(ord) filter (stage <> 'EXEMPTION') as ord, max(ord) filter (stage <> 'EXEMPTION' and k <> 'block_level') as op, coalesce(bool_or(stage = 'EXEMPTION' and k <> 'block_level'), false) as ex, bool_or(k = 'parcel') as own, bool_or(k = 'survey_level') as lev, count(*) as n, count(*) filter (k = 'block_level') as nb, list(distinct stage) as have from e group by 1),
c as (select f.*, (select min(day) from e where e.uid = f.uid and e.ord = f.ord) as entered, (select bool_or(k <> 'block_level') from e where e.uid = f.uid and e.ord = f.ord) as shown from f)
select p_partkey as parcel_uid, coalesce(n, 0) as n_events, coalesce(nb, 0) as n_block_events, a.stage as current_stage, entered, cast(date '2001-06-01' - entered as bigint) as days_in_stage, case when c.ord is not null then case when shown then 'parcel' else 'block_level' end end as current_stage_evidence, b.stage as current_stage_parcel_only,
case when c.ord = 7 then null when c.ord = 6 then 'MUTATION' when c.ord = 5 then 'POSSESSION' when c.ord = 4 then 'PAYMENT' when c.ord is null then 'SEC_3_1' else 'AWARD' end as next_expected_stage,
array_to_string(list_filter(['SEC_3_1', 'SEC_3_2', 'AWARD', 'POSSESSION'], lambda m: case m when 'SEC_3_1' then 1 when 'SEC_3_2' then 2 when 'AWARD' then 4 else 6 end < coalesce(c.ord, 0) and not list_contains(have, m)), ',') as missing_mandatory,
coalesce(ex, false) as has_exemption, coalesce(ex and c.ord >= 4, false) as exemption_conflict, case when n is null then 'none' when own then 'parcel' when lev then 'survey_level' else 'block_level' end as evidence_level,
case when c.ord = 4 and date '2001-06-01' - entered > 600 then 'AWARD_NOT_PAID' when c.ord = 5 and date '2001-06-01' - entered > 300 then 'PAID_NO_POSSESSION' when c.ord = 6 and date '2001-06-01' - entered > 90 then 'POSSESSION_NO_MUTATION' end as stalled_flag
from part left join c on c.uid = p_partkey left join g a on a.ord = c.ord left join g b on b.ord = c.op""")
def q126_parcel_lifecycle(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "parcel").when(F.col("l_returnflag") == "N", "block_level").otherwise("survey_level")
    events = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("parcel_uid"), F.try_element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("l_linenumber")).alias("stage"), F.to_date("l_shipdate").alias("day"), kind.alias("link_kind"))
    limits = spark.createDataFrame([("award_to_payment", 600.0), ("payment_to_possession", 300.0)], "key string, value double")
    return lifecycle.parcel_lifecycle(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parcel_uid")), events, stages=STAGES, exempt="EXEMPTION", mandatory=["SEC_3_1", "SEC_3_2", "AWARD", "POSSESSION"], following={"POSSESSION": "MUTATION", "PAYMENT": "POSSESSION", "AWARD": "PAYMENT"},
        stalls={"AWARD": ("AWARD_NOT_PAID", "award_to_payment", 60.0), "PAYMENT": ("PAID_NO_POSSESSION", "payment_to_possession", 30.0), "POSSESSION": ("POSSESSION_NO_MUTATION", "possession_to_mutation", 90.0)}, thresholds=limits, as_of=F.lit("2001-06-01").cast("date"),
    )


@query("""with l as (select user_id as m, epoch(ts)::bigint as s, cast(value as bigint) as est, case when event_id % 3 = 0 then null else cast(value / 2 as bigint) end as tok, value / 1000 as cost, case when event_type = 'error' then 'rejected' else 'ok' end as st from events),
u as (select m, count(*) filter (st <> 'rejected' and s > 1706659200 - 86400) as rpd, coalesce(sum(coalesce(tok, est)) filter (st <> 'rejected' and s > 1706659200 - 86400), 0)::double as tpd, count(*) filter (st <> 'rejected' and s > 1706659200 - 2592000) as mc, sum(cost) as spent from l group by 1)
select m as model_id, case when rpd + 1 > 4 * 0.9 then 'rpd' when tpd + 50 > 300 * 0.9 then 'tpd' when mc + 1 > 70 * 0.9 then 'monthly_calls' when spent >= 4.0 then 'cap' end as reason, round(greatest(least(1, rpd / 4), least(1, tpd / 300), least(1, mc / 70), least(1, spent / 4.0)), 6)::double as pressure from u""")
def q127_quota(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    log = rows.select(F.col("user_id").alias("model_id"), seconds.alias("ts"), F.round("value").cast("long").alias("est_tokens"), F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") / 2).cast("long")).alias("tokens"), F.lit(0).alias("est_out"), F.lit(0).alias("tokens_out"), (F.col("value") / 1000).alias("cost"), F.when(F.col("event_type") == "error", "rejected").otherwise("ok").alias("status"))
    models = log.select("model_id").distinct().withColumns({"est_tokens": F.lit(50.0), "est_out": F.lit(0.0), "cap": F.lit(4.0), "rpm": F.lit(None).cast("double"), "rpd": F.lit(4.0), "tpd": F.lit(300.0), "monthly_calls": F.lit(70.0)})
    return router.quota(log, models, F.lit(1706659200))
