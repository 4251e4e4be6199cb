"""Inventory, overlay and ploughing queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import inventory
from evidra.sources.tables import table

from .advanced import boxes
from .register import register

QUERIES, ORACLES, query = register()


@query("select cast(year(o_orderdate) as integer) as year, " + ", ".join(f"count(*) filter (month(o_orderdate) = {m}) as m{m}" for m in range(1, 13)) + " from orders group by 1")
def q130_month_table(spark, sf_dir):
    return inventory.month_table(table(spark, sf_dir, "orders"), "o_orderdate")


@query("""with e as (select unnest([0, 1, 2, 3, 4]) as bucket, unnest([0.0, 20.0, 40.0, 60.0, 80.0])::double as low, unnest([20.0, 40.0, 60.0, 80.0, 100.0])::double as high)
select cast(bucket as integer) as bucket, low, high, (select count(*) from events where value >= low and (value < high or (high = 100 and value = high))) as n from e""")
def q131_histogram(spark, sf_dir):
    return inventory.histogram(table(spark, sf_dir, "events"), "value", [0, 20, 40, 60, 80, 100])


@query("""with s as (select unnest(['small', 'dear']) as class, unnest([sum(case when p_size <= 10 then p_size / 10 else 0 end * p_retailprice) / sum(p_retailprice), sum(coalesce(case when p_size > 40 then 0.5 end, 0) * p_retailprice) / sum(p_retailprice)]) as share from part)
select class, round(share, 4) as share from s where share > 0""")
def q132_class_shares(spark, sf_dir):
    small, dear = F.when(F.col("p_size") <= 10, F.col("p_size") / 10), F.when(F.col("p_size") > 40, 0.5)
    return inventory.class_shares(table(spark, sf_dir, "part"), {"small": small, "dear": dear, "none": F.lit(0.0)}, "p_retailprice")


@query("""with p as (select conv_id as document_id, turn as page_no from conversations group by all), d as (select distinct conv_id as document_id, case conv_id % 3 when 0 then 'FORM' when 1 then 'LIST' end as t, case conv_id % 5 when 0 then 'other_scheme' when 1 then 'scheme' end as r from conversations),
g as (select document_id, case when document_id % 2 = 0 then 'MAP' end as s, 1 as a, 2 as b from d),
t as (select p.document_id, p.page_no, case when page_no between a and b then s end as s, t from p join d using (document_id) join g using (document_id) where coalesce(r, 'unknown') <> 'other_scheme')
select document_id, page_no, coalesce(s, t) as type, case when s is not null then 'segment' else 'document' end as type_source from t where coalesce(s, t) in ('FORM', 'MAP') and (coalesce(s, t) <> 'FORM' or page_no <= 3)""")
def q133_select_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no")).distinct()
    k = F.col("document_id")
    documents = pages.select("document_id").distinct().withColumns({"classified_type": F.when(k % 3 == 0, "FORM").when(k % 3 == 1, "LIST"), "scheme_relevance": F.when(k % 5 == 0, "other_scheme").when(k % 5 == 1, "scheme")})
    segments = documents.select("document_id", F.lit(1).alias("seg_no"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.when(k % 2 == 0, "MAP").alias("doc_type"))
    return inventory.select_pages(pages, documents, segments, ["FORM", "MAP"], {"FORM": 3})


@query("""with b as (select p_partkey as uid, (p_partkey * 37) % 1000 as x0, (p_partkey * 91) % 1000 as y0, (p_partkey * 37) % 1000 + p_size as x1, (p_partkey * 91) % 1000 + p_size / 2 as y1, p_brand as state from part),
p as (select s_suppkey as plot, (s_suppkey * 53) % 1000 as x0, (s_suppkey * 71) % 1000 as y0, (s_suppkey * 53) % 1000 + 80 as x1, (s_suppkey * 71) % 1000 + 40 as y1 from supplier),
o as (select plot, state, (least(b.x1, p.x1) - greatest(b.x0, p.x0)) as w, (least(b.y1, p.y1) - greatest(b.y0, p.y0)) as h from b, p),
s as (select plot, state, w * h / 3200 as part from o where w > 0 and h > 0)
select plot, state, round(sum(part), 8) as share, round(least(1.0, (select sum(part) from s t where t.plot = s.plot)), 8) as coverage from s group by 1, 2""")
def q134_overlay_shares(spark, sf_dir):
    k = F.col("s_suppkey")
    x, y = ((k * 53) % 1000).cast("double"), ((k * 71) % 1000).cast("double")
    plots = table(spark, sf_dir, "supplier").select(k.alias("plot"), x.alias("x0"), y.alias("y0"), (x + 80).alias("x1"), (y + 40).alias("y1"))
    states = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("state"))
    found = inventory.overlay_shares(plots, boxes(spark, sf_dir), states, [], 64.0)
    return found.withColumns({"share": F.round("share", 8), "coverage": F.round("coverage", 8)})


@query("""with d as (select o_orderpriority as unit, cast(o_orderdate as date) as day, round(avg(o_totalprice) / 524288, 6) as v, round(avg(o_custkey) / 4096, 6) as bsi from orders group by 1, 2),
w as (select unit, y, make_date(y, 10, 1) as s, make_date(y + 1, 3, 1) - 1 as e from (select distinct unit from d), (select unnest(generate_series(1994, 2001)) as y)),
a as (select unit, y, s, e, day, v, day >= s and month(day) <> 12 as sup from w join d using (unit) where day between s - 60 and e),
t as (select unit, y, max(v) filter (sup) as peak from a group by all), u as (select unit, y, min(day) as top from a join t using (unit, y) where sup and v = peak group by all),
b as (select unit, y, min(v) as base from a join u using (unit, y) where day <= top group by all),
o as (select unit, y, min(day) as onset from a join t using (unit, y) join u using (unit, y) join b using (unit, y) where peak - base >= 0.15 and day <= top and day >= s - 30 and v >= base + 0.3 * (peak - base) group by all),
n as (select unit, y, day, v, bsi, base, day >= onset - 120 and day < onset - 42 as bl, day between onset - 42 and onset - 14 and v <= base + 0.05 as bare from o join b using (unit, y) join d using (unit)),
m as (select unit, y, median(bsi) filter (bl) as mid, count(*) filter (bl) as nb, count(*) filter (bare) as nw, max(bsi) filter (bare) as most from n group by all),
k as (select unit, y, median(abs(bsi - mid)) filter (bl) as mad, min(day) filter (bare and bsi = most) as hit from n join m using (unit, y) group by all),
r as (select w.unit, w.y, onset, coalesce(nw, 0) as nw, most - mid as delta, greatest(1.4826 * mad, 0.01) as noise, hit, case when peak is null then 'no_supported_series' when peak - base < 0.15 then 'no_greenup' when onset is null then 'no_onset' when coalesce(nb, 0) < 2 then 'no_baseline_obs' when nw = 0 then 'no_obs_in_window' else 'ok' end as why
from w left join t using (unit, y) left join b using (unit, y) left join o using (unit, y) left join m using (unit, y) left join k using (unit, y))
select unit, cast(y as integer) as y, onset as greenup_onset, nw as plough_nobs, round(case when why = 'ok' then delta / noise end, 4) as plough_signal, case when why = 'ok' then hit end as plough_date, round(case when why = 'ok' then delta end, 6) as plough_delta, why as plough_reason from r""")
def q135_ploughing(spark, sf_dir):
    day = F.to_date("o_orderdate")
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("unit"), day.alias("day")).agg(F.round(F.avg("o_totalprice") / 524288, 6).alias("v"), F.round(F.avg("o_custkey") / 4096, 6).alias("bsi"))
    years = spark.range(1994, 2002).select(F.col("id").cast("int").alias("y"))
    windows = daily.select("unit").distinct().crossJoin(years).select("unit", "y", F.make_date("y", F.lit(10), F.lit(1)).alias("start"), F.date_sub(F.make_date(F.col("y") + 1, F.lit(3), F.lit(1)), 1).alias("end"))
    smooth = daily.select("unit", "day", "v", (F.month("day") != 12).alias("supported"))
    found = inventory.ploughing(windows, smooth, daily.select("unit", "day", F.col("v").alias("ndvi"), "bsi"), "unit", ["y"])
    return found.withColumns({"plough_signal": F.round("plough_signal", 4), "plough_delta": F.round("plough_delta", 6)})
