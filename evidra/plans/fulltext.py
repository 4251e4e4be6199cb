"""Boolean search over whole documents."""

from __future__ import annotations

from evidra.operators import fulltext
from evidra.sources.tables import table

from .register import register

QUERIES, ORACLES, query = register()

#: Documents with both words but not the third, or with a phrase and a word.
CONDITION = ("or", ("and", "this", "from", ("not", "que")), ("and", "on the", "by"))


@query(r"""with d as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)) as words from documents),
w as (select doc_id, unnest(words) as w, generate_subscripts(words, 1) as p from d),
h as (select *, p - row_number() over o as g, lag(w) over o = 'on' and lag(p) over o = p - 1 as follows from w where w in ('this', 'from', 'que', 'on', 'the', 'by') window o as (partition by doc_id order by p)),
l as (select *, coalesce(max(case when w = 'this' then p end) over o, 0) as a, coalesce(max(case when w = 'from' then p end) over o, 0) as b, coalesce(max(case when w = 'the' and follows then p - 1 end) over o, 0) as c,
coalesce(max(case when w = 'by' then p end) over o, 0) as e from h window o as (partition by doc_id order by p rows unbounded preceding)),
s as (select *, greatest(least(a, b), least(c, e)) as start from l),
n as (select *, start > coalesce(max(start) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding), 0) as is_cover from s),
k as (select n.doc_id, 0.1 / (1 + n.g - first.g) as part from n join h as first on n.is_cover and first.doc_id = n.doc_id and first.p = n.start),
m as (select doc_id from l group by 1 having (max(a) > 0 and max(b) > 0 and count(*) filter (w = 'que') = 0) or (max(c) > 0 and max(e) > 0))
select doc_id, round(sum(part), 6) as score, count(*) as covers from k semi join m using (doc_id) group by 1""")
def q146_boolean_ranks(spark, sf_dir):
    return fulltext.ranked(table(spark, sf_dir, "documents"), CONDITION, key="doc_id", text="text")


@query()
def q147_boolean_search(spark, sf_dir):
    """The twenty best of them with headlines."""
    return fulltext.search(table(spark, sf_dir, "documents"), CONDITION, key="doc_id", text="text", k=20)
