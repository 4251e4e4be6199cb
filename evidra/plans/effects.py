"""Blocks of twelve documents as units with twelve seasons, every fourth a control, with events at seasons of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import bootstrap
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()


def effects(spark, sf_dir, times: int):
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    unit, at = F.floor(F.col("doc_id") / 12), F.pmod("doc_id", F.lit(12))
    first = 3 + F.pmod("u", F.lit(3))
    rows = docs.select(unit.alias("u"), at.alias("season"), F.sqrt("n_chars").alias("size"), (F.col("lang") == "en").cast("int").alias("english"))
    rows = rows.withColumn("period", F.when(F.col("season") < first, "baseline").when(F.col("season") < first + 3, "pending").otherwise("post"))
    control = F.pmod("u", F.lit(4)) == 0
    found = bootstrap.period_effects(
        rows.where(~control), rows.where(control), unit="u", cell="u", season="season", period="period", values=["size", "english"],
        differences=[("post", "baseline"), ("pending", "baseline")], times=times,
    )
    return found.withColumns({c: F.round(c, 6) for c in ("estimate", "ci_lo", "ci_hi")})


@query("""with r as (select doc_id // 12 as u, doc_id % 12 as season, sqrt(n_chars) as size, case lang when 'en' then 1 else 0 end + case when lang is null then null else 0 end as english from documents where doc_id is not null),
l as (select u, season, case when season < 3 + u % 3 then 'baseline' when season < 6 + u % 3 then 'pending' else 'post' end as period, unnest(['size', 'english']) as metric, unnest([size, english::double]) as v from r),
c as (select metric, season, avg(v) as m from l where u % 4 = 0 group by all), e as (select l.metric, period as effect, avg(v - m) as v, count(v) as n from l join c using (metric, season) where u % 4 <> 0 and v is not null group by all),
a as (select * from e union all select x.metric, x.effect || '-baseline', x.v - y.v, null from e x join e y on x.metric = y.metric and x.effect <> 'baseline' and y.effect = 'baseline')
select metric, effect, round(v, 6) as estimate, n from a""")
def q148_period_effects(spark, sf_dir):
    return effects(spark, sf_dir, 0).drop("ci_lo", "ci_hi")


@query()
def q149_period_intervals(spark, sf_dir):
    """The same with intervals of a thousand replicates."""
    return effects(spark, sf_dir, 1000)
