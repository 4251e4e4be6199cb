"""Lifecycle, relational and window queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import lifecycle as life
from evidra.operators import select, stats, windows
from evidra.sources.tables import changed_rows, errata, insert_new, iso_z, mark_stale, sync, table, union_arrays, upsert

from .register import register

STAGES = ["view", "click", "signup", "purchase"]
SQL_STAGES = "(values (1,'view'),(2,'click'),(3,'signup'),(4,'purchase'))"
LIMITS = {"view": 20, "click": 15, "signup": 10}
AS_OF = "2024-02-01"
QUERIES, ORACLES, query = register()


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("stage"), F.to_date("ts").alias("day"), "value", "ts")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life.lifecycle(users(spark, sf_dir), user_events(spark, sf_dir), unit="user_id", stage="stage", day="day", stages=STAGES, exempt="error", as_of=F.lit(AS_OF).cast("date"), limits=LIMITS)


LIFE_SQL = f"""
e as (select user_id, event_type as stage, cast(ts as date) as day from events),
s as (select * from {SQL_STAGES} t(ord, stage)),
p as (select user_id, e.stage, ord, min(day) as first, count(*) as n from e left join s using (stage) group by all),
f as (select user_id, max(ord) as ord, arg_max(first, ord) as entered, bool_or(stage = 'error') as exempt, list(distinct ord) filter (ord is not null) as have, sum(n) as n from p group by user_id),
life as (select f.user_id, s.stage as current_stage, cast(f.ord as integer) as ord, entered, cast(date '{AS_OF}' - entered as bigint) as days_in_stage,
  case when f.ord < 4 then (select stage from s x where x.ord = f.ord + 1) end as next_stage,
  case when f.ord is not null then coalesce((select string_agg(stage, ',' order by x.ord) from s x where x.ord < f.ord and not list_contains(f.have, x.ord)), '') end as missing,
  coalesce(exempt and f.ord > 1, false) as conflict,
  coalesce(date '{AS_OF}' - entered >= case s.stage when 'view' then 20 when 'click' then 15 when 'signup' then 10 end, false) as stalled,
  cast(n as bigint) as n_events from f left join s on s.ord = f.ord)
"""


@query(f"with {LIFE_SQL} select * from life")
def q01_lifecycle(spark, sf_dir):
    return lives(spark, sf_dir)


@query(f"with {LIFE_SQL} select cast(user_id % 7 as bigint) as grp, coalesce(current_stage, 'none') as stage, count(*) as units, count(*) filter (stalled) as stalled from life group by 1, 2")
def q02_stage_matrix(spark, sf_dir):
    return life.stage_matrix(lives(spark, sf_dir).withColumn("grp", F.col("user_id") % 7), "grp")


@query(f"select s.stage, cast(s.ord as integer) as ord, count(distinct e.user_id) as units from {SQL_STAGES} s(ord, stage) left join events e on e.event_type = s.stage group by 1, 2")
def q03_funnel(spark, sf_dir):
    return life.funnel(user_events(spark, sf_dir), unit="user_id", stage="stage", stages=STAGES)


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def q04_distinct_on(spark, sf_dir):
    return select.first_per(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(f"""with u as (select distinct user_id from events), d as (select user_id, unnest([date '2024-01-08', date '2024-01-20']) as on_day from u),
s as (select * from {SQL_STAGES} t(ord, stage)), m as (select d.user_id, on_day, max(ord) as ord from d left join events e on e.user_id = d.user_id and cast(e.ts as date) <= on_day left join s on s.stage = e.event_type group by 1, 2)
select user_id, on_day, stage as stage_at from m left join s using (ord)""")
def q05_asof_stage(spark, sf_dir):
    points = users(spark, sf_dir).select("user_id", F.explode(F.array(F.lit("2024-01-08").cast("date"), F.lit("2024-01-20").cast("date"))).alias("on_day"))
    return life.stage_at(points, user_events(spark, sf_dir), unit="user_id", at="on_day", stage="stage", day="day", stages=STAGES)


@query("""select l_orderkey, count(*) as lines, max(l_quantity) filter (l_returnflag = 'A') as max_a, max(l_quantity) filter (l_returnflag = 'N') as max_n,
max(l_quantity) filter (l_returnflag = 'R') as max_r, count(*) filter (l_linestatus = 'O') as n_open from lineitem group by 1""")
def q06_filtered_pivot(spark, sf_dir):
    best = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(f"max_{flag.lower()}")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), best("A"), best("N"), best("R"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"))


@query("""select user_id, string_agg(event_type || '@' || strftime(ts, '%Y-%m-%d'), ' ' order by cast(ts as date), coalesce(ord, 99), event_type) as events
from events left join """ + SQL_STAGES + """ s(ord, stage) on stage = event_type group by 1""")
def q57_event_list(spark, sf_dir):
    return life.event_list(user_events(spark, sf_dir), unit="user_id", stage="stage", day="day", stages=STAGES)


DAYS = "d as (select distinct user_id, cast(ts as date) as day from events)"


@query(f"""with {DAYS}, g as (select user_id, day, lead(day) over (partition by user_id order by day) - day as gap from d where day between date '2024-01-03' and date '2024-01-28')
select user_id, count(*) as n_days, cast(greatest(coalesce(max(gap), 0), min(day) - date '2024-01-03', date '2024-01-28' - max(day)) as bigint) as max_gap from g group by 1""")
def q15_max_gap(spark, sf_dir):
    return windows.longest_gap(user_events(spark, sf_dir), ["user_id"], "day", F.lit("2024-01-03").cast("date"), F.lit("2024-01-28").cast("date"))


@query(f"""with {DAYS}, i as (select user_id, day, day - cast(row_number() over (partition by user_id order by day) as integer) as k from d)
select user_id, min(day) as first, max(day) as last, count(*) as n from i group by user_id, k having count(*) >= 2""")
def q16_streaks(spark, sf_dir):
    return windows.streaks(user_events(spark, sf_dir), ["user_id"], "day", 2)


@query("""with c as (select user_id, event_id, event_type, case when row_number() over w = 1 then 1 when event_type is not distinct from lag(event_type) over w then 0 else 1 end as ch from events window w as (partition by user_id order by event_id)),
r as (select *, sum(ch) over (partition by user_id order by event_id) as run from c)
select user_id, cast(run as bigint) as run, any_value(event_type) as event_type, min(event_id) as first, max(event_id) as last, count(*) as n from r group by user_id, run""")
def q17_segments(spark, sf_dir):
    return windows.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""with m as (select o_orderpriority as p, cast(year(o_orderdate) as integer) as y, sum(o_totalprice) as v, count(*) as n from orders group by 1, 2)
select p, y, round(v, 2) as v, n, round(case when lag(y) over w = y - 1 and n >= 5 and lag(n) over w >= 5 then v - lag(v) over w end, 2) as delta from m window w as (partition by p order by y)""")
def q14_yoy_delta(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    return windows.year_over_year(sums, ["p"], "y", "v", F.col("n") >= 5).select("p", "y", F.round("v", 2).alias("v"), "n", F.round("delta", 2).alias("delta"))


@query("""select event_id, round(sum(value) over (partition by user_id order by epoch(ts) range between 60 preceding and current row), 4) as minute, round(sum(value) over (partition by user_id order by epoch(ts) range between 86400 preceding and current row), 4) as day,
round(sum(value) over (partition by user_id order by epoch(ts) range between 2592000 preceding and current row), 4) as month from (select event_id, user_id, value, date_trunc('second', ts) as ts from events)""")
def q36_quota_window(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    spans = {"minute": 60, "day": 86400, "month": 2592000}
    return windows.rolling_sum(table(spark, sf_dir, "events"), ["user_id"], seconds, "value", spans).select("event_id", *[F.round(c, 4).alias(c) for c in spans])


@query("""with m as (select c_nationkey, c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer)
select c_custkey, c_nationkey, last_value(seg ignore nulls) over (partition by c_nationkey order by c_custkey rows unbounded preceding) as seg from m""")
def q58_fill_down(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return windows.fill_down(rows, ["c_nationkey"], "c_custkey", "seg")


@query("""with k as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as r from lineitem),
o as (select l_orderkey, r, min(case when l_linenumber = r then 1 else 0 end) over (partition by l_orderkey order by r) as ok from k)
select l_orderkey, cast(sum(ok) as bigint) as n from o group by 1""")
def q59_leading_serial(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))
    return windows.leading_serial(lines, ["l_orderkey"], "at", "l_linenumber")


@query("""with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as r, count(*) over (partition by p_brand) as n from part)
select p_partkey, p_brand, cast(case when (r - 1) * 3 <= n - 1 then 0 when (r - 1) * 3 <= (n - 1) * 2 then 1 else 2 end as bigint) as tertile from r""")
def q60_tertiles(spark, sf_dir):
    return windows.tertile(table(spark, sf_dir, "part"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "p_brand", "tertile")


@query("select s_suppkey, s_nationkey, cast(row_number() over (partition by s_nationkey order by md5(cast(s_suppkey as varchar) || '|7')) - 1 as bigint) as turn from supplier")
def q61_round_robin(spark, sf_dir):
    order = F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit("|7")))
    return windows.round_robin(table(spark, sf_dir, "supplier"), "s_nationkey", [order]).select("s_suppkey", "s_nationkey", "turn")


@query("""select facet, value, count(*) as n from (select 'o_orderstatus' as facet, o_orderstatus as value from orders union all select 'o_orderpriority', o_orderpriority from orders) where value is not null group by 1, 2""")
def q51_facets(spark, sf_dir):
    return select.facets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderstatus = 'O' order by o_orderpriority, o_orderkey limit 50 offset 25")
def q52_paged_list(spark, sf_dir):
    rows = select.where_given(table(spark, sf_dir, "orders"), o_orderstatus="O", o_custkey=None).select("o_orderkey", "o_orderpriority", "o_totalprice")
    return select.page(rows, [F.col("o_orderpriority"), F.col("o_orderkey")], 50, 25)


@query("select l_partkey as id from lineitem where l_quantity > 45 union select l_suppkey from lineitem where l_discount > 0.05 union select p_partkey from part where p_size > 40")
def q53_union_distinct(spark, sf_dir):
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    ids = lines.where("l_quantity > 45").select(F.col("l_partkey").alias("id")).union(lines.where("l_discount > 0.05D").select("l_suppkey")).union(parts.where("p_size > 40").select("p_partkey"))
    return ids.distinct()


@query("select c_custkey, c_nationkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey)")
def q54_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


BANDS = "(values (0, 1000, 'low'), (1000, 1500, 'mid'), (1500, 3000, 'high')) b(lo, hi, band)"


@query(f"select p_partkey, band from part join {BANDS} on p_retailprice >= lo and p_retailprice < hi")
def q55_range_join(spark, sf_dir):
    bands = F.broadcast(spark.createDataFrame([(0, 1000, "low"), (1000, 1500, "mid"), (1500, 3000, "high")], "lo int, hi int, band string"))
    return table(spark, sf_dir, "part").join(bands, (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).select("p_partkey", "band")


@query("""select c_custkey, o_orderkey, o_totalprice from customer left join lateral (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) on true""")
def q56_lateral(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return table(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


HALVES = "old as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 3 <> 0), new as (select o_orderkey, case when o_orderkey % 2 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice + case when o_orderkey % 5 = 0 then 1 else 0 end as o_totalprice from orders where o_orderkey % 4 <> 1)"


def halves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 4 <> 1").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("o_totalprice"))
    return orders.where("o_orderkey % 3 <> 0"), new


@query(f"with {HALVES} select * from new union all select * from old where o_orderkey not in (select o_orderkey from new)")
def q42_upsert(spark, sf_dir):
    return upsert(*halves(spark, sf_dir), ["o_orderkey"])


@query(f"with {HALVES} select new.* from new left join old using (o_orderkey) where old.o_orderkey is null or new.o_orderstatus is distinct from old.o_orderstatus or not coalesce(abs(new.o_totalprice - old.o_totalprice) <= 0.0001, false)")
def q43_change_only(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return changed_rows(old, new, ["o_orderkey"], {"o_orderstatus": None, "o_totalprice": 1e-4})


@query(f"with {HALVES} select * from old union all select * from new where o_orderkey not in (select o_orderkey from old)")
def q62_insert_new(spark, sf_dir):
    return insert_new(*halves(spark, sf_dir), ["o_orderkey"])


@query(f"with {HALVES} select * from old where o_orderkey in (select o_orderkey from new)")
def q63_full_sync(spark, sf_dir):
    return sync(*halves(spark, sf_dir), ["o_orderkey"])


@query(f"""with {HALVES}, o as (select *, case when o_orderkey % 7 = 0 then 'ok' end as verdict from old)
select o_orderkey, o_totalprice, verdict, case when o_orderkey in (select o_orderkey from new) then o_orderstatus else 'stale' end as o_orderstatus from o where verdict is not null or o_orderkey in (select o_orderkey from new)""")
def q64_mark_stale(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return mark_stale(old.withColumn("verdict", F.when(F.col("o_orderkey") % 7 == 0, "ok")), new, ["o_orderkey"], "verdict", "o_orderstatus")


@query("""with a as (select l_suppkey as k, l_returnflag as x, l_tax > 0.07 as f from lineitem where l_linenumber <= 2), b as (select l_suppkey as k, l_linestatus as x, l_tax > 0.079 as f from lineitem where l_linenumber > 2)
select k, list_sort(list(distinct x)) as xs, bool_or(f) as f from (select * from a union all select * from b) group by k""")
def q65_union_arrays(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a = lines.where("l_linenumber <= 2").select(F.col("l_suppkey").alias("k"), F.array("l_returnflag").alias("xs"), (F.col("l_tax") > 0.07).alias("f"))
    b = lines.where("l_linenumber > 2").select(F.col("l_suppkey").alias("k"), F.array("l_linestatus").alias("xs"), (F.col("l_tax") > 0.079).alias("f"))
    pre = [x.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("xs"))).alias("xs"), F.bool_or("f").alias("f")) for x in (a, b)]
    return union_arrays(*pre, "k", "xs", "f")


@query("""with a as (select *, row_number() over (partition by user_id, event_type order by event_id) as r from events) select event_id, user_id, event_type, lag(event_id) over (partition by user_id, event_type order by event_id) as supersedes from a""")
def q66_errata(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return errata(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("select p_partkey, p_brand from part order by md5(cast(p_partkey as varchar) || '|7'), p_partkey limit 50")
def q67_seeded_sample(spark, sf_dir):
    return select.seeded_sample(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "7", 50)


@query("select doc_id, list_filter(['short', 'not_english', 'no_lang', 'big'], lambda x, i: [n_chars < 500, lang <> 'en', lang is null, n_chars > 5000][i]) as reasons from documents")
def q68_reasons(spark, sf_dir):
    checks = {"short": F.col("n_chars") < 500, "not_english": F.col("lang") != "en", "no_lang": F.col("lang").isNull(), "big": F.col("n_chars") > 5000}
    return table(spark, sf_dir, "documents").select("doc_id", select.reasons(checks).alias("reasons"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at from events")
def q69_iso_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", iso_z(F.col("ts")).alias("at"))


@query("""select c_nationkey, c_custkey, c_acctbal, cast(rank as integer) as rank from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer) where rank <= 3""")
def q70_top_k(spark, sf_dir):
    return select.top_per(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@query("""select c_custkey, o_orderkey from customer full join (select * from orders where o_totalprice > 100000) on o_custkey = c_custkey""")
def q71_full_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("""select r_name, n_name, count(*) as n, round(sum(c_acctbal), 2) as bal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by cube (r_name, n_name)""")
def q72_cube(spark, sf_dir):
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def q73_pricing_summary(spark, sf_dir):
    price, disc = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))
    )
