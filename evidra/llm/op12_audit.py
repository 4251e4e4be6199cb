"""How filters act on each other: a trie of all their orders, walked depth-first over persisted survivors.

The state behind a prefix of an order depends only on which filters it holds, so the n! orders share 2**n states. The
walk starts at all rows; from a state it goes on, filter by filter, to the survivors of one filter more, unless that
set of filters has been reached before. A state is a persisted DataFrame made by filtering its parent's, and is given
up when the walk leaves it, so at most n + 1 are held at a time. On each edge the removed rows are counted in the state itself,
by part; what a filter would have removed from all rows, less that, was removed before it.

Filters are columns that say whether a row fails. They are worked out once a row, before the walk: rows are narrow from
there on (a part, one flag a filter and one a label), and checkpointed, so a lost executor's states are filtered again
from that table. Counts are summed in each task before they are shuffled by part, and no part is gathered. The result
has a line for each part, order and step; 2**n states and n! orders bound n: more than MOST filters are an error.

Edge cases: null and empty texts are empty texts (no words); a null source is the part ''; a null id is neither smaller than
another nor has it smaller ones, and rows that repeat an id don't make each other fail; labels that repeat an id count as one
label that says yes if any does; an empty table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, hot_keys, spread_join

MOST = 7
SPACE = r"[\x20\x09-\x0D]+"


def walk(rows: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, state, filter, kept, removed, lost_{label} of every edge of the trie; a part without a row in the state has no line.

    rows: part and boolean columns f_{filter}, l_{label}. A state is named by its filters, as they are listed."""
    counted: list[DataFrame] = []
    reached: set[frozenset[str]] = set()

    def edges(state: frozenset[str], survivors: DataFrame) -> DataFrame:
        ahead = [f for f in filters if f not in state]
        lost = lambda f: [F.count_if(F.col(f"f_{f}") & F.col(f"l_{x}")).alias(f"lost_{x}") for x in labels]
        line = [F.struct(F.lit(f).alias("filter"), F.count_if(~F.col(f"f_{f}")).alias("kept"), F.count_if(f"f_{f}").alias("removed"), *lost(f)) for f in ahead]
        found = survivors.groupBy("part").agg(F.array(*line).alias("edges"))
        return found.select("part", F.lit("".join(f for f in filters if f in state)).alias("state"), F.inline("edges"))

    def visit(state: frozenset[str], survivors: DataFrame) -> None:
        reached.add(state)
        if len(state) == len(filters):
            return
        survivors = survivors.persist()
        counted.append(edges(state, survivors).persist())
        counted[-1].count()
        for f in filters:
            if f not in state and state | {f} not in reached:
                visit(state | {f}, survivors.where(~F.col(f"f_{f}")))
        survivors.unpersist()

    visit(frozenset(), rows)
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    out = cut(out)
    for more in counted:
        more.unpersist()
    return out


def audit(rows: DataFrame, part: Column, filters: Mapping[str, Column], labels: Mapping[str, Column]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, {label}_lost, shapley of every part, order and step.

    filters: failure conditions by a one-letter name (null: does not fail); labels: conditions whose removed rows are counted."""
    if len(filters) > MOST or any(len(f) != 1 for f in filters):
        raise ValueError(f"at most {MOST} filters with names of one letter")
    names, marks, n = list(filters), list(labels), len(filters)
    flag = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    flags = cut(rows.select(part.alias("part"), *[flag(c).alias(f"f_{f}") for f, c in filters.items()], *[flag(c).alias(f"l_{x}") for x, c in labels.items()]))
    edges = walk(flags, names, marks)

    alone = lambda f: F.col(f"f_{f}") & ~F.greatest(F.lit(False), F.lit(False), *[F.col(f"f_{g}") for g in names if g != f])
    line = [F.struct(F.lit(f).alias("filter"), F.count_if(f"f_{f}").alias("fails"), F.count_if(alone(f)).alias("unique_fails")) for f in names]
    whole = flags.groupBy("part").agg(F.array(*line).alias("all")).select("part", F.inline("all"))

    orders = [("".join(o), k + 1, "".join(f for f in names if f in o[:k]), o[k]) for o in permutations(names) for k in range(n)]
    order_table = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, state string, filter string")
    shares = {(s, f): factorial(len(s)) * factorial(n - 1 - len(s)) for _, _, s, f in orders}
    edge_table = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("weight")) for (s, f), w in shares.items()]))
    numbers = ["kept", "removed", *[f"lost_{x}" for x in marks]]
    every = whole.select("part").distinct().select("part", edge_table.alias("e")).select("part", "e.*")
    every = every.join(edges, ["part", "state", "filter"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in numbers})
    every = cut(every.join(whole, ["part", "filter"]))
    shapley = every.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    lost = [F.col(f"lost_{x}").alias(f"{x}_lost") for x in marks]
    found = every.join(shapley, ["part", "filter"]).join(F.broadcast(order_table), ["state", "filter"])  # n * n! lines
    return found.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def text_checks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """part, a to e (whether a document fails), good, toxic of every document. docs: doc_id, text, source; marks: doc_id, quality, toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    read = read.select("*", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"), F.unhex(F.sha2("text", 256)).alias("digest"))
    few, varied = F.size("words") < 50, 100 * F.size(F.array_distinct("words")) >= 65 * F.size("words")
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long")
    checks = {"a": few, "b": ~varied, "c": capitals, "d": F.col("text").rlike("[#$%&*|]")}
    narrow = cut(read.select("id", "part", "digest", *[c.alias(f) for f, c in checks.items()], F.monotonically_increasing_id().alias("_row")))

    texts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    texts = cut(texts.where(F.col("first") < F.col("last")))
    known = marks.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.where(F.col("id").isNotNull()).groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    ids = narrow.groupBy("id").agg(F.count("*").alias("n"))
    rows = spread_join(narrow, texts.select("digest", "first"), ["digest"], hot_keys(texts, ["digest"]), ["_row"], "left")
    rows = spread_join(rows, known, ["id"], hot_keys(ids, ["id"]), ["_row"], "left")
    return rows.withColumn("e", F.col("id") > F.col("first"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_checks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(rows, F.col("part"), {f: F.col(f.lower()) for f in "ABCDE"}, {"good": F.col("good"), "toxic": F.col("toxic")})


ORACLE = r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
m as (select t, min(doc_id) as first from d group by t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, cast(len(w) < 50 as int) + 2 * cast(100 * len(list_distinct(w)) < 65 * len(w) as int)
  + 4 * cast(100 * len(regexp_extract_all(w.t, '[A-Z]')) > 5 * length(w.t) as int) + 8 * cast(regexp_matches(w.t, '[#$%&*|]') as int) + 16 * cast(coalesce(w.doc_id > first, false) as int) as mask
  from w join m using (t) left join l using (doc_id)),
g as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, mask),
i as (select unnest([0, 1, 2, 3, 4]) as i),
p as (select [a.i, b.i, c.i, d.i, e.i] as o from i a, i b, i c, i d, i e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select list_aggregate(list_transform(o, lambda x: chr(65 + x)), 'string_agg', '') as filter_order, k as step, o[k] as f, 1 << o[k] as bit, coalesce(list_sum(list_transform(o[1:k - 1], lambda x: 1 << x)), 0)::int as pre from p, (select unnest([1, 2, 3, 4, 5]) as k)),
r as (select part, filter_order, step, f, coalesce(sum(n) filter ((mask & pre) = 0 and (mask & bit) = 0), 0) as kept, coalesce(sum(n) filter ((mask & pre) = 0 and (mask & bit) <> 0), 0) as removed,
  coalesce(sum(n) filter ((mask & pre) <> 0 and (mask & bit) <> 0), 0) as redundant, coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
  coalesce(sum(good) filter ((mask & pre) = 0 and (mask & bit) <> 0), 0) as good_lost, coalesce(sum(toxic) filter ((mask & pre) = 0 and (mask & bit) <> 0), 0) as toxic_lost
  from s, g group by part, filter_order, step, f)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from r"""
