"""Router, refresh, record and overview queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import records, refresh, router
from evidra.sources.tables import geojson, table

from .register import register

QUERIES, ORACLES, query = register()


@query("""with c as (select s_suppkey, s_nationkey, round(s_acctbal * 0.001 + s_nationkey * 0.01, 6) as score from supplier where s_acctbal > 0 and s_nationkey <> 3)
select s_suppkey, s_nationkey, score, row_number() over (partition by s_nationkey order by score desc, s_suppkey) as place from c""")
def q90_route_ranking(spark, sf_dir):
    checks = {"broke": F.col("s_acctbal") <= 0, "barred": F.col("s_nationkey") == 3}
    fit = router.eligible(table(spark, sf_dir, "supplier"), checks).where("eligible")
    return router.ranked(fit, "s_nationkey", {"s_acctbal": 0.001, "s_nationkey": 0.01}, "s_suppkey").select("s_suppkey", "s_nationkey", "score", "place")


@query("""with g as (select event_type, count(*) as calls, round(avg(case when value < 90 then 1.0 else 0.0 end), 4) as success, list_sort(list(value) filter (value < 90)) as l, round(sum(value), 4) as cost from events group by 1)
select event_type, calls, success, l[cast(round_even(0.5 * (len(l) - 1), 0) as integer) + 1] as p50, l[cast(round_even(0.95 * (len(l) - 1), 0) as integer) + 1] as p95, cost from g""")
def q91_router_usage(spark, sf_dir):
    return router.usage(table(spark, sf_dir, "events"), ["event_type"], F.col("value") < 90, "value", "value")


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by event_id desc) as r from events where event_type <> 'error') select user_id, case when count(*) >= 3 then median(value) end as p50 from r where r <= 5 group by 1""")
def q92_recent_median(spark, sf_dir):
    return router.recent_median(table(spark, sf_dir, "events"), "user_id", "event_id", "value", F.col("event_type") != "error", 5, 3)


@query("""with s as (select event_id, user_id, sum(value) over (partition by user_id order by event_id rows unbounded preceding) as spent from events) select event_id, round(spent, 4) as spent, case when spent > 300 then 'capped' when spent >= 240 then 'stopping' else 'open' end as state from s""")
def q93_spend_guard(spark, sf_dir):
    return router.spend(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 300.0).select("event_id", F.round("spent", 4).alias("spent"), "state")


@query("""with d as (select user_id, cast(ts as date) as day, sum(value) as day_sum, count(*) * 1.0 as calls from events group by 1, 2)
select user_id, day, round(greatest(day_sum / 90.0, calls / 3), 6) as pressure, case when day_sum > 90.0 then 'day' when calls > 3 then 'calls' end as over from d""")
def q94_quota_pressure(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("on"), "event_id", "value")
    used = router.used(log, ["user_id", "on"], "event_id", "value").select("user_id", "on", F.col("cost").alias("day"), F.col("calls").cast("double").alias("calls"))
    return router.quota_check(used, {"day": 100.0, "calls": 3.0}).select("user_id", F.col("on").alias("day"), "pressure", "over")


@query("""with k as (select * from orders where o_orderkey % 3 = 0) select o_orderkey, case when o_orderkey in (select o_orderkey from k) then 'known' when exists (select 1 from k where k.o_custkey = o.o_custkey and k.o_orderpriority = o.o_orderpriority) then 'reprocessed' when o_orderstatus = 'P' then 'unusable' else 'new' end as kind from orders o""")
def q95_classify_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = refresh.classify_new(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey", ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") != "P")
    return found.select("o_orderkey", "kind")


@query("""with r as (select *, first_value(l_partkey) over (partition by l_orderkey, l_returnflag order by l_linenumber desc, l_quantity desc, l_extendedprice desc, l_partkey desc) as best from lineitem)
select l_orderkey, l_returnflag, max(best) as l_partkey, count(*) filter (l_partkey <> best) as n_losers from r group by 1, 2""")
def q96_best_version(spark, sf_dir):
    best = refresh.best_version(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], [F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice")], "l_partkey")
    return best.select("l_orderkey", "l_returnflag", "l_partkey", F.size("losers").cast("long").alias("n_losers"))


@query("""with t as (select distinct l_suppkey as k from lineitem where l_shipdate >= timestamp '2001-07-01'), e as (select distinct l_suppkey as a, l_partkey % 100 as b from lineitem), u as (select a, b from e union select b, a from e)
select k from t union select b from t join u on a = k""")
def q97_affected_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    touched = lines.where("l_shipdate >= timestamp '2001-07-01'").select(F.col("l_suppkey").alias("k")).distinct()
    edges = lines.select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 100).alias("b")).distinct()
    return refresh.affected(touched, edges, "k", "b")


@query("""with u as (select distinct user_id from events), p as (select distinct event_type from events), c as (select event_type, user_id, count(e.user_id) as n from u cross join p left join events e using (user_id, event_type) group by 1, 2)
select event_type, round(quantile_cont(n, 0.1), 4) as p10, round(quantile_cont(n, 0.5), 4) as p50, round(quantile_cont(n, 0.9), 4) as p90, count(*) as units from c group by 1""")
def q98_coverage(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = refresh.coverage(events.select("user_id"), events.select("event_type"), events, "user_id", "event_type")
    return found.withColumns({c: F.round(c, 4) for c in ("p10", "p50", "p90")})


@query("""select o_orderkey, unnest(['o_orderstatus', 'o_totalprice', 'o_orderpriority']) as fact, unnest([null, o_totalprice, null]) as value_num, unnest([o_orderstatus, null, o_orderpriority]) as value_text from orders""")
def q99_long_facts(spark, sf_dir):
    facts = records.long_facts(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderpriority"])
    return facts.withColumn("value_text", F.when(F.col("value_num").isNull(), F.col("value_text")))


@query("""select doc_id, case when regexp_matches(text, '[0-9]{8}') and not regexp_matches(text, '@') then 'numbers' when regexp_matches(text, '[|]') or regexp_matches(text, '[{]') then 'markup' when regexp_matches(text, '@') then 'mail' end as label from documents""")
def q100_rule_classes(spark, sf_dir):
    rules = [("mail", 0.5, ["@"], []), ("numbers", 0.9, ["[0-9]{8}"], ["@"]), ("markup", 0.7, ["[|]", "[{]"], [])]
    return table(spark, sf_dir, "documents").select("doc_id", records.classify(F.col("text"), rules).alias("r")).select("doc_id", "r.label")


@query("""with r as (select doc_id, source as value from documents), d as (select doc_id, case doc_id % 3 when 0 then 'corrected' when 1 then 'rejected' else 'approved' end as decision, 'fixed' as nv from documents where doc_id % 2 = 0)
select doc_id, case when decision = 'corrected' then nv when decision = 'rejected' then null else value end as value, coalesce(decision, 'pending') as status, case when decision = 'corrected' then value end as ai_original from r left join d using (doc_id)""")
def q101_review(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "corrected").when(F.col("doc_id") % 3 == 1, "rejected").otherwise("approved")
    decisions = docs.where("doc_id % 2 = 0").select("doc_id", kind.alias("decision"), F.lit("fixed").alias("new_value"))
    return records.review(docs.select("doc_id", F.col("source").alias("value")), decisions, "doc_id")


@query("""with p as (select doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) as parts from documents), q as (select doc_id, parts, unnest(generate_series(1, len(parts))) as page_no from p) select doc_id, cast(page_no as integer) as page_no, coalesce(parts[page_no], '') as text from q""")
def q102_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text")).withColumn("n", F.size(F.split("text", "\f")))
    return records.pages_of(docs, "doc_id", "text", "n")


@query("""select 'customers' as kpi, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'open_orders', count(*) filter (o_orderstatus = 'O') from orders union all select 'parts_sold', count(distinct l_partkey) from lineitem""")
def q103_overview(spark, sf_dir):
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("kpi"), "n")
    orders = table(spark, sf_dir, "orders")
    kpis = [one("customers", table(spark, sf_dir, "customer"), F.count("*")), one("orders", orders, F.count("*")), one("open_orders", orders, F.count_if(F.col("o_orderstatus") == "O")), one("parts_sold", table(spark, sf_dir, "lineitem"), F.count_distinct("l_partkey"))]
    out = kpis[0]
    for k in kpis[1:]:
        out = out.unionByName(k)
    return out


@query("""select s_suppkey, '{"type":"Feature","id":' || s_suppkey || ',"geometry":{"type":"Point","coordinates":[' || s_suppkey % 360 || ',' || s_suppkey % 90 || ']},"properties":{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}}' as feature from supplier""")
def q104_geojson(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("*", (F.col("s_suppkey") % 360).alias("x"), (F.col("s_suppkey") % 90).alias("y"))
    return geojson(rows, "s_suppkey", "x", "y", ["s_name", "s_nationkey"])


@query()
def q105_greedy_pairs(spark, sf_dir):
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("a"), (F.col("l_suppkey") % 5).alias("b")).agg(F.max("l_quantity").alias("s"))
    return records.greedy_pairs(scores, "g", "a", "b", "s")
