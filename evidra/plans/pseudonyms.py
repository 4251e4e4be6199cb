"""Pseudonyms over whole documents, numbered per source, and their exact way back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import pseudonyms
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()


def long_words(spark, sf_dir):
    """Stand-ins for names: words of ten letters or more that the benchmark's items use."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    return words.where(F.length("name") >= 10).distinct()


@query("""with names as (select distinct lower(w) as w from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from benchmark) where length(w) >= 10),
words as (select doc_id, source, unnest(list_zip(range(1, len(regexp_extract_all(text, '[A-Za-z]+')) + 1), regexp_extract_all(text, '[A-Za-z]+'))) as p from documents),
hits as (select doc_id, source, p[1] as i, lower(p[2]) as w from words join names on lower(p[2]) = names.w),
firsts as (select source, w, min((doc_id, i)) as first from hits group by source, w),
tokens as (select source, w, concat('⟨OWNER_', row_number() over (partition by source order by first), '⟩') as token from firsts),
pieces as (select doc_id, source, unnest(list_zip(range(1, len(regexp_split_to_array(text, '[A-Za-z]+')) + 1), regexp_split_to_array(text, '[A-Za-z]+'), regexp_extract_all(text, '[A-Za-z]+'))) as p from documents where text is not null),
shown as (select doc_id, string_agg(concat(p[2], coalesce(token, p[3], '')), '' order by p[1]) as text, count(token) as n from pieces left join tokens on tokens.source is not distinct from pieces.source and tokens.w = lower(p[3]) group by doc_id)
select documents.doc_id, md5(shown.text) as shown, coalesce(n, 0) as n_names, true as restored from documents left join shown using (doc_id)""")
def q150_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.md5("text").alias("was"))
    public, _ = pseudonyms.pseudonymise(docs, "doc_id", ["text"], "source", long_words(spark, sf_dir))
    counted = public.withColumns({"shown": F.md5("text"), "n_names": F.size("private").cast("long")})
    back = pseudonyms.restore(counted, ["text"])
    return back.select("doc_id", "shown", "n_names", F.md5("text").eqNullSafe(F.col("was")).alias("restored"))


@query("""with names as (select distinct w from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from benchmark) where length(w) >= 10),
texts as (select distinct lower(text) as t, count(*) as n from documents group by lower(text))
select w as name, cast(sum(n) as bigint) as n_rows from names join texts on contains(t, lower(w)) group by w""")
def q151_residual_names(spark, sf_dir):
    return pseudonyms.residual(table(spark, sf_dir, "documents"), ["text"], long_words(spark, sf_dir))
