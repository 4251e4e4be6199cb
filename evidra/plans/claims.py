"""Claims about blocks of a hundred documents, held against what the documents give."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import claims
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()


def div(c, n: int):
    return F.floor(c / n)


@query("""with d as (select doc_id // 100 as t, n_chars as n, lang from documents where doc_id is not null),
f as (select t, count(*) as n_rows, sum(n) as area_sum, max(n) as area_union, count(*) filter (lang = 'fr' and n > 400) as n_obs, count(*) filter (lang = 'en') / count(*) as crop_share, count(*) filter (n > 300) / count(*) as coverage from d group by t),
c as (select t, 'rows' as field, n_rows - case when t % 5 = 1 then 1 else 0 end = n_rows as ok, t % 5 = 1 as far, n_rows from f
union all select t, 'area_sum', t % 5 < 1 and area_union <= area_sum + 0.0001, abs(area_sum * (t % 5) * 0.004) > greatest(0.01, 0.01 * area_sum * (1 + (t % 5) * 0.004)), 0 from f
union all select t, 'n_obs', n_obs >= 2, false, 0 from f
union all select t, 'crop_share', case when t % 3 < 2 then (crop_share >= 0.5) = (t % 3 = 0) else true end, false, 0 from f
union all select t, 'other', false, false, 0 from f)
select concat(t, ':', field) as claim_id, case when field = 'rows' then ok and (not far or abs(1.0) <= greatest(0.01, 0.01 * n_rows)) else ok and not far end as supported,
case field when 'rows' then case when ok then '' else 'count_matches_rows' end when 'area_sum' then case when ok then '' else 'equal' end when 'n_obs' then case when ok then '' else 'satellite_min_obs' end when 'crop_share' then case when ok then '' else 'crop_share_consistent' end else 'looks_right' end as failed,
case when field = 'rows' then far and 1.0 > greatest(0.01, 0.01 * n_rows) else far end as refuted from c""")
def q144_claim_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    t, n = div(F.col("doc_id"), 100), F.col("n_chars")
    wide = docs.groupBy(t.alias("t")).agg(
        F.count("*").alias("rows"), F.sum(n).alias("area_sum"), F.max(n).alias("area_union"), F.count_if((F.col("lang") == "fr") & (n > 400)).alias("n_obs"),
        (F.count_if(F.col("lang") == "en") / F.count("*")).alias("crop_share"), (F.count_if(n > 300) / F.count("*")).alias("coverage"),
    )
    named = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("label")) for c in wide.columns[1:]]
    facts = wide.select(F.col("t").cast("string").alias("subject"), F.inline(F.array(*named)))
    t = F.col("t")

    def claim(field: str, value, label, *names: str):
        return F.struct(F.lit(field).alias("field"), value.cast("double").alias("value"), label.cast("string").alias("label"), F.array(*[F.lit(x) for x in names]).alias("checks"))

    none = F.lit(None)
    made = F.array(
        claim("rows", F.col("rows") - F.when(t % 5 == 1, 1).otherwise(0), none, "count_matches_rows"), claim("area_sum", F.col("area_sum") * (1 + t % 5 * 0.004), none, "equal", "union_le_sum"),
        claim("n_obs", none, none, "satellite_min_obs"), claim("crop_share", none, F.when(t % 3 == 0, "crop").when(t % 3 == 1, "no_crop").otherwise("insufficient_data"), "crop_share_consistent"), claim("other", none, none, "looks_right"),
    )
    asked = wide.select(t.cast("string").alias("subject"), F.inline(made)).withColumns({"claim_id": F.concat_ws(":", "subject", "field"), "kind": F.lit("number")})
    found = claims.verdicts(asked, claims.checks(asked, facts), claims.refutations(asked, facts))
    return found.select("claim_id", "supported", F.array_join("failed", ",").alias("failed"), "refuted")
