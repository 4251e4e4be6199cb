"""Statistics, findings, linkage, text, vectors and calendar queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import calendar, normalise
from evidra.operators import calibration, findings, match, search, select, states, stats
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()


@query("""with m as (select p_brand, median(l_extendedprice / l_quantity) as med from lineitem join part on l_partkey = p_partkey where l_linenumber % 2 = 0 group by 1),
s as (select p_brand, any_value(med) as med, greatest(1.4826 * median(abs(l_extendedprice / l_quantity - med)), 1.0) as scale from lineitem join part on l_partkey = p_partkey join m using (p_brand) where l_linenumber % 2 = 0 group by 1)
select l_orderkey, l_linenumber, p_brand, round((l_extendedprice / l_quantity - med) / scale, 4) + 0.0::double as z from lineitem join part on l_partkey = p_partkey left join s using (p_brand) where l_linenumber % 2 = 1""")
def q12_mad_zscore(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"))
    z = stats.robust_z(rows.where("l_linenumber % 2 = 1"), rows.where("l_linenumber % 2 = 0"), ["p_brand"], "rate", 1.0)
    return z.select("l_orderkey", "l_linenumber", "p_brand", (F.round("z", 4) + F.lit(0.0)).alias("z"))


@query("""with c as (select c_nationkey, c_acctbal from customer where c_mktsegment = 'BUILDING')
select c_custkey, c_nationkey, round((select count(*) from c where c.c_nationkey = a.c_nationkey and c.c_acctbal <= a.c_acctbal) / nullif((select count(*) from c where c.c_nationkey = a.c_nationkey), 0), 6) as share from customer a where c_mktsegment <> 'BUILDING'""")
def q13_percent_rank_vs_controls(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    ranked = stats.percent_rank_among(rows.where("c_mktsegment <> 'BUILDING'").drop("c_mktsegment"), rows.where("c_mktsegment = 'BUILDING'"), ["c_nationkey"], "c_acctbal")
    return ranked.select("c_custkey", "c_nationkey", F.round("share", 6).alias("share"))


RATE = "r as (select l_partkey, l_orderkey, l_linenumber, l_extendedprice as paid, l_quantity as size, l_extendedprice / l_quantity as rate, round_even(l_extendedprice / l_quantity / 100, 0) * 100 as near from lineitem)"
MODE = f"{RATE}, n as (select l_partkey, near, count(*) as n from r group by 1, 2), m as (select l_partkey, near as rate from (select *, row_number() over (partition by l_partkey order by n desc, near) as k from n) where k = 1), s as (select l_partkey, m.rate as rate, count(*) filter (abs(r.rate - m.rate) <= 0.005 * m.rate) as support, count(*) as rows from r join m using (l_partkey) group by 1, 2 having count(*) filter (abs(r.rate - m.rate) <= 0.005 * m.rate) >= greatest(1.0, count(*) / 20))"


@query(f"with {MODE} select * from s")
def q07_modal_rate(spark, sf_dir):
    return rates(spark, sf_dir)


def rates(spark, sf_dir):
    return findings.modal_rate(table(spark, sf_dir, "lineitem"), ["l_partkey"], F.col("l_extendedprice"), F.col("l_quantity"), unit=100.0, least=1, part=0.05)


@query(f"""with {MODE} select l_orderkey, l_linenumber, round(paid - size * s.rate, 4) as diff, case when paid > 10 * size * s.rate or paid * 10 < size * s.rate then 'extraction_error' else 'mismatch' end as category,
case when paid > 10 * size * s.rate or paid * 10 < size * s.rate then 'low' when abs(paid - size * s.rate) >= 1e5 then 'high' when abs(paid - size * s.rate) >= 1e4 then 'medium' else 'low' end as severity,
case when paid > 10 * size * s.rate or paid * 10 < size * s.rate then 0.8::double else 0.7::double end as confidence, 'parcel' as evidence_level from r join s using (l_partkey) where abs(paid - size * s.rate) > 1 + 0.005 * s.rate""")
def q08_comp_mismatch(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = findings.compensation_mismatch(rows, rates(spark, sf_dir), ["l_partkey"], "l_extendedprice", "l_quantity")
    return found.select("l_orderkey", "l_linenumber", F.round("diff", 4).alias("diff"), "category", "severity", "confidence", "evidence_level")


@query("""with c as (select o_orderkey, o_totalprice / 1000 as area, l_extendedprice / 1000 as e, l_returnflag as doc, l_linenumber as ord from orders join lineitem on l_orderkey = o_orderkey),
o as (select o_orderkey, area, e as claimed, 0 as kind, ord from c union all select o_orderkey, area, sum(e), 1, min(ord) from c group by o_orderkey, area, doc having count(*) > 1),
b as (select *, row_number() over (partition by o_orderkey order by round(abs(claimed - area), 6), kind, ord, claimed) as r from o)
select o_orderkey, round(claimed, 6) as claimed, round(claimed - area, 6) as off, case when kind = 1 then 'doc_sum' else 'row' end as basis, case when claimed / area > 10 or claimed / area < 0.1 then 'extraction_error' else 'mismatch' end as category,
case when claimed / area > 10 or claimed / area < 0.1 then 'low' when abs(claimed - area) >= 1 or abs(claimed - area) / area >= 0.5 then 'high' when abs(claimed - area) >= 0.2 then 'medium' else 'low' end as severity,
case when claimed / area > 10 or claimed / area < 0.1 then 0.8::double else 0.85::double end as confidence, 'parcel' as evidence_level from b where r = 1 and area > 0 and abs(claimed - area) / area > 0.05""")
def q09_extent_mismatch(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", (F.col("o_totalprice") / 1000).alias("area"), (F.col("l_extendedprice") / 1000).alias("e"), F.col("l_returnflag").alias("doc"), F.col("l_linenumber").alias("ord"))
    found = findings.extent_mismatch(claims, unit="o_orderkey", area="area", extent="e", document="doc", order="ord")
    return found.withColumns({"claimed": F.round("claimed", 6), "off": F.round("off", 6)})


@query("""with s as (select 'P' || l_partkey % 400 as village, floor(l_extendedprice * 10) / 10000 as total, case when l_suppkey % 7 = 0 then 'GO' else 'LIST' end as doc_type, l_suppkey as document_id, l_linenumber as page_no from lineitem),
g as (select village, arg_min(total, document_id * 100 + page_no) as go from (select village, min(total) as total, document_id, page_no from s where doc_type = 'GO' group by 1, 3, 4) group by 1),
k as (select document_id, page_no from s join g using (village) where abs(total - go) <= 0.05 * go group by 1, 2 having count(*) >= 5), f as (select s.* from s join k using (document_id, page_no)),
v as (select village, list_sort(list(distinct total)) as "values", min(total) as low, max(total) as high, round(max(total) - min(total), 4) as spread from f group by 1)
select *, case when spread >= 1 then 'high' else 'medium' end as severity, 0.8::double as confidence, 'village' as evidence_level from v where high - low > 0.01 and len("values") > 1""")
def q10_doc_version_conflict(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    sources = lines.select(F.concat(F.lit("P"), (F.col("l_partkey") % 400).cast("string")).alias("village"), (F.floor(F.col("l_extendedprice") * 10) / 10000).alias("total"), F.when(F.col("l_suppkey") % 7 == 0, "GO").otherwise("LIST").alias("doc_type"), F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page_no"))
    return findings.version_conflict(sources, place="village", value="total", kind="doc_type", document="document_id", page="page_no").drop("sanctioned")


@query("""with s as (select c_custkey, c_nationkey as village, cast(c_custkey % 4 as integer) as block_id, c_acctbal / 1000 as ha, date '2023-01-01' + cast(c_custkey % 500 as integer) as since, case when c_custkey % 6 = 0 then 'parcel' else 'block' end as level, (c_custkey * 37 % 9000)::double as road from customer),
i as (select * from s where date '2024-02-01' - since >= 6 * 30.44 and c_custkey not in (select user_id from events where event_type = 'purchase'))
select village, block_id, round(sum(ha), 4) as idle_ha, count(*) as n_parcels, min(since) as oldest, case when bool_or(level = 'parcel') then 'parcel' else 'block' end as evidence_level, round(min(road) / 1000, 3) as road, round((date '2024-02-01' - min(since)) / 30.44, 1)::double as months_since_oldest,
case when round(sum(ha), 4) >= 20 then 'high' when round(sum(ha), 4) >= 5 then 'medium' else 'low' end as severity, case when bool_or(level = 'parcel') then 0.75::double else 0.6::double end as confidence from i group by 1, 2""")
def q11_idle_bank(spark, sf_dir):
    k = F.col("c_custkey")
    units = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("village"), (k % 4).cast("int").alias("block_id"), (F.col("c_acctbal") / 1000).alias("ha"), F.date_add(F.lit("2023-01-01").cast("date"), (k % 500).cast("int")).alias("since"), F.when(k % 6 == 0, "parcel").otherwise("block").alias("level"), (k * 37 % 9000).cast("double").alias("road"))
    cleared = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return findings.idle_bank(units, cleared, unit="c_custkey", group=["village", "block_id"], since="since", size="ha", level="level", as_of=F.lit("2024-02-01").cast("date"), distances=["road"])


SEASON = "case when month(d) between 6 and 9 then 'kharif' when month(d) between 3 and 5 then 'summer' else 'rabi' end"


@query(f"""select cast(case when month(d) >= 6 then year(d) else year(d) - 1 end as integer) as ag_year, {SEASON} as season, count(*) as n, round(sum(o_totalprice), 2) as total from (select cast(o_orderdate as date) as d, o_totalprice from orders) group by 1, 2""")
def q18_season_assign(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(calendar.ag_year(day).alias("ag_year"), calendar.season(day).alias("season")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with w as (select * from (values ('pre', date '1995-06-01', date '1996-06-01'), ('pending', date '1996-06-01', date '1997-03-01'), ('post_award', date '1997-03-01', date '1998-01-01'), ('post_possession', date '1998-01-01', date '2000-01-02')) t(name, s, e)),
o as (select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) + 90 as b from orders)
select o_orderkey, (select name from w where 2 * greatest(least(b, e - 1) - greatest(a, s) + 1, 0) > 91 limit 1) as window_name from o""")
def q19_event_windows(spark, sf_dir):
    days = [F.lit(x).cast("date") for x in ("1996-06-01", "1997-03-01", "1998-01-01", "2000-01-01")]
    a = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", calendar.majority_window(a, F.date_add(a, 90), calendar.event_windows(*days)).alias("window_name"))


FEAT = f"""f as (select l_partkey, cast(case when month(d) >= 6 then year(d) else year(d) - 1 end as integer) as y, {SEASON} as season, l_quantity >= 3 as enough, l_discount * 8 as mx, l_discount * 5 as mn, l_tax * 5 as amp, l_discount * 6 as dry, l_tax - 0.07 as ndwi,
l_linenumber % 3 as peaks, l_tax * 6 as nbr, -l_tax * 3 as yoy, l_orderkey * 10 + l_linenumber as ord from (select *, cast(l_shipdate as date) as d from lineitem))"""
RULE = """case when not enough then 'insufficient_data' when ndwi > 0 and mx < 0.3 then 'water'
when season = 'rabi' then case when mx < 0.3 and nbr >= 0.3 and yoy <= -0.15 then 'cleared_or_built' when dry >= 0.38 and amp < 0.25 then 'perennial_veg' when peaks >= 1 and amp >= 0.25 then 'cropped' else 'bare_fallow' end
when peaks >= 1 and mx >= 0.45 and amp >= 0.2 then 'cropped' when mn >= 0.3 then 'perennial_veg' else 'bare_fallow' end"""


def season_states(spark, sf_dir):
    day, discount, tax = F.to_date("l_shipdate"), F.col("l_discount"), F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").withColumns({"y": calendar.ag_year(day), "season": calendar.season(day), "ord": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "mx": discount * 8})
    state = states.season_rule(F.col("season"), F.col("l_quantity") >= 3, F.col("mx"), discount * 5, tax * 5, discount * 6, tax - 0.07, F.col("l_linenumber") % 3, tax * 6, -tax * 3)
    return rows.select("l_partkey", "y", "season", "ord", "mx", state.alias("state"))


@query(f"with {FEAT} select y, season, {RULE} as state, count(*) as n from f group by all")
def q22_season_rule(spark, sf_dir):
    return season_states(spark, sf_dir).groupBy("y", "season", "state").agg(F.count("*").alias("n"))


@query(f"""with {FEAT}, s as (select l_partkey, y, season, ord, {RULE} as state from f), m as (select *, case when state = 'cropped' and count(*) filter (state = 'cropped') over (partition by l_partkey, y) >= 2 then 'irrigated_multi' else state end as multi from s),
w as (select p_partkey as l_partkey, case p_partkey % 4 when 0 then 'tree' when 1 then 'built' when 2 then 'crop' else 'water' end as cover, p_size / 50 as share from part)
select ord, l_partkey, y, season, case when ((y = 2000 and season = 'summer') or (y = 2001 and season in ('kharif', 'rabi'))) and cover in ('tree', 'built', 'water') and share >= 0.6 and multi <> 'insufficient_data' then case cover when 'tree' then 'perennial_veg' when 'built' then 'cleared_or_built' else 'water' end else multi end as prior_state,
case when ((y = 2000 and season = 'summer') or (y = 2001 and season in ('kharif', 'rabi'))) and cover in ('tree', 'built', 'water') and share >= 0.6 and multi <> 'insufficient_data' then 'cover' else 'rules' end as prior_src from m left join w using (l_partkey)""")
def q106_rule_states(spark, sf_dir):
    k = F.col("p_partkey")
    cover = table(spark, sf_dir, "part").select(k.alias("l_partkey"), F.when(k % 4 == 0, "tree").when(k % 4 == 1, "built").when(k % 4 == 2, "crop").otherwise("water").alias("cover"), (F.col("p_size") / 50).alias("share"))
    shifted = season_states(spark, sf_dir).withColumn("y", F.col("y") + 20)  # the cover map is of 2020 and 2021, the table twenty years older
    out = states.rule_states(shifted, "l_partkey", "y", "season", "state", cover)
    return out.select("ord", "l_partkey", (F.col("y") - 20).alias("y"), "season", "prior_state", "prior_src")


@query(f"""with {FEAT}, s as (select l_partkey, y, {RULE} as state, round(1 - mx / 4, 4) as p, ord from f), m as (select *, case when state = 'cropped' and ord % 5 = 0 then 'irrigated_multi' else state end as st from s),
c as (select l_partkey, y, st, count(*) as n, min(ord) as first, min(p) as p from m group by all),
t as (select *, row_number() over (partition by l_partkey, y order by n desc, first) as r from c where st <> 'insufficient_data'),
k as (select l_partkey, y, coalesce(cast(sum(n) filter (st in ('cropped', 'irrigated_multi')) as bigint), 0) as nc, min(p) filter (st in ('cropped', 'irrigated_multi')) as pc, bool_or(st = 'irrigated_multi') as multi from c group by 1, 2)
select k.l_partkey, k.y, case when nc >= 2 or multi then 'irrigated_multi' when nc = 1 then 'cropped' else coalesce(st, 'insufficient_data') end as annual_state, case when nc > 0 then pc else p end as p_state, nc as n_crop from k left join t on t.l_partkey = k.l_partkey and t.y = k.y and r = 1""")
def q20_annual_state(spark, sf_dir):
    state = F.when((F.col("state") == "cropped") & (F.col("ord") % 5 == 0), "irrigated_multi").otherwise(F.col("state"))
    rows = season_states(spark, sf_dir).select("l_partkey", "y", state.alias("state"), F.round(1 - F.col("mx") / 4, 4).alias("p"), "ord")
    return states.annual_state(rows, ["l_partkey", "y"], "state", "p", "ord")


@query("""with v as (select doc_id, case when n_chars > 1500 then 'a' else 'b' end as x, case lang when 'en' then 'a' when 'de' then null else 'b' end as y, case when length(source) > 4 then 'a' when doc_id % 5 = 0 then null else 'c' end as z, case when doc_id % 2 = 0 then 0.7 else 0.3 end as p, doc_id % 7 = 0 as gone from documents),
w as (select doc_id, case when gone then null else x end as x, y, z, p from v),
g as (select doc_id, x, y, z, p, list_filter([x, y, z], lambda q: q is not null) as l from w),
o as (select *, case when len(l) = 0 then 'none' when len(l) = 1 then 'single' when len(l) = 3 and len(list_distinct(l)) = 1 then '3of3' when len(l) = 3 and len(list_distinct(l)) = 2 then '2of3' when len(l) = 3 then 'none' when len(list_distinct(l)) = 1 then '2of2'
when z is not null and p >= 0.6 then 'split_vlm' else 'split' end as agreement from g)
select doc_id, agreement, case when agreement in ('3of3', '2of3', '2of2') then case when x = y or x = z then x else y end when agreement = 'split_vlm' then coalesce(x, y) end as label from o""")
def q21_vote(spark, sf_dir):
    sure = F.when(F.col("doc_id") % 2 == 0, 0.7).otherwise(0.3)
    labels = {
        "one": F.when(F.col("doc_id") % 7 != 0, F.when(F.col("n_chars") > 1500, "a").otherwise("b")), "two": F.when(F.col("lang") == "en", "a").when(F.col("lang") == "de", None).otherwise("b"),
        "prior": F.when(F.length("source") > 4, "a").when(F.col("doc_id") % 5 != 0, "c"),
    }
    vote = states.vote(labels, {"one": sure, "two": sure})
    return table(spark, sf_dir, "documents").select("doc_id", vote.alias("v")).select("doc_id", "v.agreement", "v.label")


@query("""with e as (select user_id, event_type, count(*) as n from events group by 1, 2), t as (select *, max(n) over (partition by user_id) as top, sum(n) over (partition by user_id) as every from e)
select user_id, cast(any_value(every) as bigint) as n, case when count(*) = 1 then max(event_type) else 'mixed' end as dominant, round(any_value(top) / any_value(every), 3) as share from t where n = top group by 1""")
def q74_dominant(spark, sf_dir):
    return stats.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type")


PRED = "p as (select l.doc_id, quality as truth, case when n_chars > 1200 then 1 else 0 end as pred, least(n_chars / 4000.0, 1.0) as prob from labels l join documents using (doc_id))"


def predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("truth"), F.when(F.col("n_chars") > 1200, 1).otherwise(0).alias("pred"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).cast("double").alias("prob"))


@query(f"""with {PRED}, c as (select k as class, count(*) filter (truth = k and pred = k) as tp, count(*) filter (truth <> k and pred = k) as fp, count(*) filter (truth = k and pred <> k) as fn from p, (values (0), (1)) t(k) group by 1)
select class, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""")
def q35_confusion_prf(spark, sf_dir):
    return stats.class_metrics(predictions(spark, sf_dir), "truth", "pred").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""with {PRED}, b as (select cast(least(floor(prob * 10), 9) as bigint) as bin, count(*) as n, avg(prob) as c, avg(truth) as a from p group by 1)
select round((select avg((prob - truth) ** 2) from p), 6) as brier, (select count(*) from p) as n, round(sum(n * abs(c - a)) / sum(n), 6) as ece from b""")
def q75_calibration(spark, sf_dir):
    return stats.brier_ece(predictions(spark, sf_dir), "prob", "truth").select(F.round("brier", 6).alias("brier"), "n", F.round("ece", 6).alias("ece"))


@query("""with l as (select user_id, list_sort(list(value)) as v from events group by 1) select user_id, v[cast(round_even(0.5 * (len(v) - 1), 0) as integer) + 1] as p50, v[cast(round_even(0.95 * (len(v) - 1), 0) as integer) + 1] as p95 from l""")
def q76_nearest_rank(spark, sf_dir):
    return stats.nearest_ranks(table(spark, sf_dir, "events"), ["user_id"], "value", {"p50": 0.5, "p95": 0.95})


#: Parts stand for parcels of a village (brand); a part's record names it exactly, with zeros, by survey, by prefix, misread, as a list, or by a wrong village.
LINKS = """u as (select p_partkey as uid, p_brand as village, p_partkey % 60 as s, p_size as z, cast(p_partkey % 60 as varchar) as survey, p_size || 'A' as sub, cast(p_partkey % 4 as integer) as block, p_retailprice / 100 as area from part),
r as (select p_partkey as id, case when p_partkey % 13 = 0 then 'Nowhere' else p_brand end as village, unnest(case when p_partkey % 7 = 6 then [1, 2] else [1] end) as i, case when p_partkey % 7 = 6 then 2 else 1 end as n, survey,
case when p_partkey % 7 = 2 then '' when p_partkey % 7 = 3 then cast(p_size as varchar) when p_partkey % 7 = 4 then replace(replace(sub, '1', '7'), '3', '8') when p_partkey % 7 = 5 then 'Z' when p_partkey % 7 = 6 and i = 2 then (p_size + 1) || 'A' else sub end as d,
cast(case when p_partkey % 3 = 0 then null when p_partkey % 3 = 1 then p_partkey % 4 else 1 end as integer) as block, case when p_partkey % 5 = 0 then area * 1.05 when p_partkey % 5 = 1 then area * 3 end as extent, p_partkey % 11 = 0 as header from part join u on uid = p_partkey)"""
LINK_ONE = """j as (select r.id, r.i, u.uid, u.block as ub, u.area, r.block, r.extent, r.header, r.d, u.sub, {again} as again,
case when u.survey = r.survey and u.sub = r.d then 1 when u.survey = r.survey and r.d = '' then 3 when u.survey = r.survey and r.d <> '' and starts_with(u.sub, r.d) then 3 when length(u.survey) = length(r.survey) and length(u.sub) = length(r.d) and x between 1 and 2 and bad = 0 then 4 end as rank, x
from {refs} r join u on u.village = r.village, lateral (select coalesce(len(list_filter(range(1, len(r.survey || '/' || r.d) + 1), lambda k: substr(r.survey || '/' || r.d, k, 1) <> substr(u.survey || '/' || u.sub, k, 1))), 0) as x,
coalesce(len(list_filter(range(1, len(r.survey || '/' || r.d) + 1), lambda k: substr(r.survey || '/' || r.d, k, 1) <> substr(u.survey || '/' || u.sub, k, 1) and (substr(r.survey || '/' || r.d, k, 1) || substr(u.survey || '/' || u.sub, k, 1)) not in ('38', '83', '17', '71', '06', '60', '56', '65', 'A4', '4A'))), 0) as bad)),
b as (select *, min(rank) over (partition by id, i) as least, count(*) over (partition by id, i, rank) as c, sum(area) over (partition by id, i, rank) as total from j where rank is not null),
k as (select *, case when rank = 3 and d = '' and c > 1 then 'survey_level' else 'unit' end as tier, case when rank = 3 and d = '' and c > 1 then total else area end as a, case rank when 1 then 1.0 when 3 then case when d = '' then case when c > 1 then 0.85 else 0.9 end else 0.8 end else case x when 1 then 0.65 else 0.45 end end as base from b where rank = least),
s as (select *, round(greatest(least(base + case when tier = 'unit' and block is not null then case when block = ub then 0.05 else -0.1 end else 0 end + case when extent is null then 0 when abs(extent - a) / a <= 0.1 then 0.05 when extent > 1.5 * a + 0.05 then -0.1 else 0 end + case when header then -0.05 else 0 end + case when again then -0.05 else 0 end, 1), 0), 6)::double as score from k),
q as (select *, row_number() over (partition by id, i order by score desc, uid) as place from s),
m as (select id, i, bool_or(tier = 'survey_level') as lev, max(score) filter (place = 1) as top, coalesce(max(score) filter (place = 2), 0) as nx, min(uid) filter (place = 1) as uid, count(*) as c from q group by 1, 2),
v as (select r.id, r.i, r.n, m.uid, top, case when top is null then 'no_candidate' when lev then case when top >= 0.8 then 'survey_level' else 'ambiguous' end when top >= 0.8 and round(top - nx, 6) >= 0.1 then 'accepted' else 'ambiguous' end as status, c from {refs} r left join m on m.id = r.id and m.i = r.i),
o as (select id, case when any_value(n) = 1 then min(status) when count(*) filter (status in ('accepted', 'survey_level')) = 2 then 'list' when count(*) filter (status in ('accepted', 'survey_level')) > 0 then 'list_partial' when count(top) > 0 then 'ambiguous' else 'no_candidate' end as status,
min(uid) filter (n = 1 and status = 'accepted') as uid, case when any_value(n) = 1 then min(top) else min(top) filter (status in ('accepted', 'survey_level')) end as score, cast(coalesce(sum(case status when 'accepted' then 1 when 'survey_level' then c end), 0) as bigint) as n_links from v group by 1)"""


def link_tables(spark, sf_dir):
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    survey, size = (n % 60).cast("string"), F.col("p_size").cast("string")
    sub, area, kind = F.concat(size, F.lit("A")), F.col("p_retailprice") / 100, n % 7
    none = F.lit(None).cast("int")
    units = part.select(n.alias("uid"), F.col("p_brand").alias("village"), F.concat_ws("/", survey, sub).alias("code"), (n % 4).cast("int").alias("block"), none.alias("unit"), area.alias("area"))
    named = (
        F.when(kind == 2, F.lit(None)).when(kind == 3, size).when(kind == 4, F.translate(sub, "13", "78")).when(kind == 5, F.lit("z"))
        .when(kind == 6, F.concat(sub, F.lit(" and "), (F.col("p_size") + 1).cast("string"), F.lit("-a"))).when(kind == 1, F.concat(F.lit("00"), size, F.lit("-a (plot)"))).otherwise(sub)
    )
    records = part.select(
        n.alias("id"), F.when(n % 13 == 0, "Nowhere").otherwise(F.col("p_brand")).alias("village"), F.when(kind == 1, F.concat(F.lit("0"), survey)).otherwise(survey).alias("survey_no"), named.alias("sub_div"),
        F.when(n % 3 == 0, None).when(n % 3 == 1, n % 4).otherwise(1).cast("int").alias("block"), none.alias("unit"), F.when(n % 5 == 0, area * 1.05).when(n % 5 == 1, area * 3).alias("extent"),
        (n % 11 == 0).alias("from_header"), F.lit(False).alias("header_conflict"), F.lit(False).alias("scheme_header"),
    )
    return records, units


@query(f"""with {LINKS}, first as (with {LINK_ONE.format(refs="r", again="false")} select * from o where id not in (select id from r where village = 'Nowhere')),
mv as (select * from r where (village = 'Nowhere' or header) and id not in (select id from first where status <> 'no_candidate')),
ov as (select mv.id, min(u.village) as village from mv join u on u.survey = mv.survey and (mv.d = '' or u.sub = mv.d) and u.block = mv.block and u.village <> mv.village group by 1 having count(distinct u.village) = 1),
r2 as (select mv.* replace (ov.village as village) from mv join ov on ov.id = mv.id), second as (with {LINK_ONE.format(refs="r2", again="true")} select * from o where status <> 'no_candidate'),
e as (select *, null as nv from first where id not in (select id from second) union all select second.*, ov.village from second join ov using (id))
select p_partkey as id, coalesce(nv, case when p_partkey % 13 = 0 then 'Nowhere' else p_brand end) as village, coalesce(status, 'no_village') as status, uid, score, coalesce(n_links, 0) as n_links from part left join e on id = p_partkey""")
def q23_match_tiers(spark, sf_dir):
    found = match.link(*link_tables(spark, sf_dir))
    return found.select("id", "village", "status", "uid", "score", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


@query("""select event_id, regexp_extract(t, '^([0-9]+)', 1) as survey, nullif(regexp_extract(t, '^[0-9]+ *(?:[/-] *([0-9A-Z]+))?', 1), '') as subdivision from (select event_id, case event_id % 3 when 0 then event_id || '/' || user_id || 'A' when 1 then event_id || ' - ' || user_id else cast(event_id as varchar) end as t from events)""")
def q24_survey_parse(spark, sf_dir):
    n, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("S.F.No. "), n, F.lit("/"), u, F.lit("a"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Survey No: "), n, F.lit(" - "), u)).otherwise(n)
    return table(spark, sf_dir, "events").select("event_id", normalise.survey_ref(raw).alias("r")).select("event_id", "r.survey", "r.subdivision")


@query("select o_orderkey, cast(floor(round(o_totalprice, 2)) as bigint) as amount from orders")
def q25_amount_parse(spark, sf_dir):
    text = F.concat(F.lit("paid Rs. "), F.format_number("o_totalprice", 2), F.lit(" in 3 parts"))
    return table(spark, sf_dir, "orders").select("o_orderkey", normalise.amount(text).alias("amount"))


@query("""select event_id, case event_id % 3 when 0 then cast(ts as date) when 1 then date_trunc('month', cast(ts as date))::date else make_date(cast(year(ts) as bigint), 1, 1) end as value, case event_id % 3 when 0 then 'day' when 1 then 'month' else 'year' end as precision from events""")
def q26_date_parse(spark, sf_dir):
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, F.date_format("ts", "'dated' d/M/yyyy")).when(kind == 1, F.date_format("ts", "'in' MMMM yyyy")).otherwise(F.date_format("ts", "'during' yyyy"))
    return table(spark, sf_dir, "events").select("event_id", normalise.parse_date(text).alias("d")).select("event_id", "d.value", "d.precision")


KNOWN = ("the", "and", "that", "with", "from", "this", "are", "was")


@query(f"""with b as (select doc_id, text, regexp_replace(text, '[ \t\n\r\v\f]', '', 'g') as bare, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') as words from documents)
select doc_id, round(case when length(bare) > 0 then 0.6 * length(regexp_replace(bare, '[^A-Za-z0-9.,]', '', 'g')) / length(bare) + 0.4 * case when len(words) > 0 then len(list_filter(words, lambda w: w in {KNOWN})) / len(words) else 0 end else 0 end, 6) as quality from b""")
def q27_text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(normalise.text_quality(F.col("text"), "A-Za-z0-9.,", KNOWN), 6).alias("quality"))


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
c as (select doc_id, len(w) as n, len(list_filter(w, lambda x: x = 'from')) as a, len(list_filter(w, lambda x: x = 'this')) as b from w)
select doc_id, round((a + b) / (1 + ln(cast(n as double) + 1)), 6) as score, cast((a > 0)::int + (b > 0)::int as integer) as hits from c where a + b > 0 order by score desc, doc_id limit 20""")
def q28_fts_rank(spark, sf_dir):
    return search.text_search(table(spark, sf_dir, "documents"), ["this", "from"], key="doc_id", text="text", k=20)


@query("select sha256(text) as digest, min(lpad(cast(doc_id as varchar), 12, '0')) as primary_path, count(*) as n from documents group by 1 having count(*) > 1")
def q29_exact_dups(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    return search.duplicate_groups(files, "digest", "path").withColumnRenamed("primary", "primary_path")


@query(r"""select conv_id, turn, regexp_replace(regexp_replace(text, '[0-9]{9,}', '[number]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', '[mail]', 'g') as text from conversations""")
def q31_pii_mask(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalise.mask_mail(normalise.mask_numbers(F.col("text"))).alias("text"))


@query("select c_custkey, 'OWNER-' || substr(md5('s1:' || c_name), 1, 10) as token from customer")
def q32_pseudonymise(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", normalise.pseudonym(F.col("c_name"), "s1").alias("token"))


@query("""with s as (select a.vec_id as query, b.vec_id as vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) as score from embeddings a, embeddings b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query, vec_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s) where rank <= 5""")
def q33_cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search.cosine_top_k(vectors, vectors.where("vec_id % 50 = 0"), key="vec_id", vector="embedding", k=5)


@query("select event_id, cast(json_extract(props, '$.k') as double) as k from events")
def q34_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", normalise.json_number(F.col("props"), "$.k").alias("k"))


@query("""select p_partkey, round(z * 2.47105::double, 4) as ac, round(z * 40.4686::double / 10000, 4) as ha, abs(z * 2.47105::double - round(z * 2.47105::double, 4)) <= 0.02 as agree from (select p_partkey, p_size::double + 0.37 as z from part)""")
def q77_units(spark, sf_dir):
    ha = F.col("p_size").cast("double") + 0.37
    ac = normalise.ha_to_ac(ha)
    return table(spark, sf_dir, "part").select("p_partkey", ac.alias("ac"), normalise.cents_to_ha(ha).alias("ha"), normalise.extents_agree(ha, ac).alias("agree"))


@query("""with c as (select l_orderkey, sum(l_extendedprice) as s, count(*) as n from lineitem group by 1)
select o_orderkey, round(s, 4) as summed, o_totalprice, case when s is null or o_totalprice is null then 'skip' when abs(s - o_totalprice) <= 50000 then 'pass' else 'fail' end as outcome from orders left join c on l_orderkey = o_orderkey""")
def q78_total_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    found = findings.total_checks(rows, table(spark, sf_dir, "orders"), "o_orderkey", "l_extendedprice", "o_totalprice", F.lit(50000.0))
    return found.withColumn("summed", F.round("summed", 4))


@query("""with a as (select c_nationkey as k, round(sum(c_acctbal), 2) as v from customer where c_nationkey <> 3 group by 1), b as (select s_nationkey as k, round(sum(s_acctbal) * 15, 2) as v from supplier group by 1)
select k, case when b.v is null then 'only_left' when a.v is null then 'only_right' when abs(a.v - b.v) > 0.2 * abs(b.v) then 'differs' else 'agrees' end as outcome from a full join b using (k)""")
def q79_reconcile(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.sum("s_acctbal") * 15, 2).alias("v"))
    return findings.reconcile(a, b, ["k"], "v", 0.2)


@query("""select o_orderpriority, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderpriority order by md5(cast(o_orderkey as varchar) || '|7'), o_orderkey) as r from orders) where r <= 5""")
def q80_audit_sample(spark, sf_dir):
    return findings.keyed_audit(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus"), "o_orderpriority", "o_orderkey", 5, "7")


@query("""with s as (select c_mktsegment, count(*) as n from customer group by 1), q as (select c_mktsegment, least(n, greatest(1, floor(100 * sqrt(n) / (select sum(sqrt(n)) from s)))) as quota from s)
select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by md5(cast(c_custkey as varchar) || '|11'), c_custkey) as r from customer) join q using (c_mktsegment) where r <= quota""")
def q81_stratified(spark, sf_dir):
    return select.stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 100, "11")


@query("select source, lang, count(*) as n, round(avg(n_chars), 2) as mean, round(quantile_cont(n_chars, 0.5), 4) as p50, round(quantile_cont(n_chars, 0.9), 4) as p90 from documents group by 1, 2")
def q82_quantiles(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean"), F.round(F.percentile("n_chars", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("n_chars", F.lit(0.9)), 4).alias("p90"))


@query("""with benchmark as (select item_id, regexp_replace(text, '[^ -~]', '?', 'g') as text from benchmark) select a.item_id as item_id, levenshtein(a.text, b.text) as distance, round(levenshtein(a.text, b.text) / length(a.text), 6) as cer from benchmark a join benchmark b on b.item_id = a.item_id + 1""")
def q83_character_error(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("t"))
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("o"))
    return items.join(other, "item_id").select("item_id", F.levenshtein("t", "o").cast("long").alias("distance"), F.round(normalise.character_error(F.col("t"), F.col("o")), 6).alias("cer"))


@query("""with r as (select doc_id, coalesce(lang, '') as lang, (n_chars % 211) / cast(211 as double) as score, case when (doc_id * 7919) % 211 < n_chars % 211 then 1.0 else 0.0 end as y from documents where doc_id is not null),
a as (select lang, score, sum(y) as y, count(*) as w from r group by lang, score), p as (select *, sum(y) over (partition by lang order by score) as cy, sum(w) over (partition by lang order by score) as cw from a),
m as (select a.lang, a.score as s0, b.score as s1, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) as mean from p a join p b on a.lang = b.lang and b.score >= a.score),
u as (select lang, s0, s1, min(mean) over (partition by lang, s0 order by s1 desc) as least from m), v as (select lang, s1 as score, max(least) as level from u group by lang, s1)
select doc_id, lang, round(score, 6) as score, round(level, 8) as level from r join v using (lang, score)""")
def q143_calibrated(spark, sf_dir):
    n = F.col("n_chars") % 211
    truth = F.when(F.col("doc_id") * 7919 % 211 < n, 1.0).otherwise(0.0)
    rows = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), (n / F.lit(211.0)).alias("score"), truth.alias("truth"))
    found = calibration.calibrated(rows, ["lang"], "score", calibration.isotonic(rows, ["lang"], "score", "truth"))
    return found.select("doc_id", "lang", F.round("score", 6).alias("score"), F.round("level", 8).alias("level"))
