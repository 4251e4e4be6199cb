"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). On the
small graph source of flow -> pattern -> source -> sink a min-cost flow routes words: a pattern
offers its words once at cost 0, again at cost 1, a third time at cost 3 (convex, so repeats
are spread before anything is taken a third time), and each source's quota is its target. A pattern's routed words divided by
its size give whole repeats for all its documents, and the rest is met by the documents that
come first in a seeded order.

That order is a hash of seed, id and text. The place where it is cut is found in two rounds of
4,096 hash buckets with summed sizes, so no pattern, however large, is sorted in one task; only
the last bucket (a 16-millionth of the pattern) is summed item by item. Rows with the same id and text (and null ids with the
same text) are one item of many copies: as many of its rows are taken as come nearest to the need. What reaches
the driver is one row per pattern and one per pattern and bucket on the cut; patterns are few:
their number is checked against max_patterns, beyond which mix() raises (the flow is solved on the driver).

Edge cases: null text has size 0 and takes 0; null source is a source of its own, last in
order; documents without any membership take nothing; an empty table gives an empty result; repeated rows are rows
of their own; other columns of the input are carried by mix() and not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

BUCKETS = 4096
COSTS = (0.0, 1.0, 3.0)
NULL = "\U0010ffff"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str, int], weights: dict[str, float], most: float, words: float) -> dict[str, float]:
    """Shares of all words by weight, none above most times its source's size; what is over is shared anew by weight."""
    left, open_, out = words, {s for s in sizes if weights[s] > 0}, {s: 0.0 for s in sizes}
    while open_:
        unit = left / sum(weights[s] for s in sorted(open_))
        full = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in sorted(full):
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def flow(patterns: Sequence[frozenset], sizes: Sequence[int], quotas: dict[str, float], costs: Sequence[float] = COSTS) -> list[float]:
    """Words taken of each pattern by a min-cost maximum flow.

    Arcs: one per pattern and repetition (capacity its size, rising cost), one per pattern and
    source it belongs to, one per source (capacity its quota). Only the arcs of repetitions cost
    anything, so shortest paths come in order of their cost: each cost in turn opens its arcs and
    is filled by blocking flows, level by level (the primal-dual way of successive shortest paths)."""
    names = sorted(quotas)
    node = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    head: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(names))]
    to: list[int] = []
    room: list[float] = []
    least = 1e-6

    def arc(a: int, b: int, capacity: float) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0.0)):
            head[x].append(len(to))
            to.append(y)
            room.append(c)
        return len(to) - 2

    opened = [[arc(0, 2 + i, 0.0) for i in range(len(patterns))] for _ in costs]
    for i, pattern in enumerate(patterns):
        for s in sorted(pattern):
            arc(2 + i, node[s], float("inf"))
    for s in names:
        arc(node[s], 1, float(quotas[s]))

    def levels() -> list[int]:
        depth, queue = [-1] * len(head), [0]
        depth[0] = 0
        for x in queue:
            for e in head[x]:
                if room[e] > least and depth[to[e]] < 0:
                    depth[to[e]] = depth[x] + 1
                    queue.append(to[e])
        return depth

    for k in sorted(range(len(costs)), key=lambda k: costs[k]):
        for e, size in zip(opened[k], sizes, strict=True):
            room[e] = float(size)
        while (depth := levels())[1] >= 0:
            next_, path, x = [0] * len(head), [], 0
            while True:
                if x == 1:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    stop = next(i for i, e in enumerate(path) if room[e] <= least)
                    x = to[path[stop] ^ 1]
                    del path[stop:]
                    continue
                while next_[x] < len(head[x]):
                    e = head[x][next_[x]]
                    if room[e] > least and depth[to[e]] == depth[x] + 1:
                        break
                    next_[x] += 1
                if next_[x] < len(head[x]):
                    path.append(head[x][next_[x]])
                    x = to[path[-1]]
                elif not path:
                    break
                else:
                    x = to[path.pop() ^ 1]
                    next_[x] += 1
    return [sum(room[opened[k][i] ^ 1] for k in range(len(costs))) for i in range(len(patterns))]


def ordered(rows: DataFrame, seed: int) -> DataFrame:
    """rows with the seeded order of their keys and texts and its two bucket numbers."""
    order = F.xxhash64(F.lit(seed), F.col("key"), F.col("digest"))
    return rows.withColumns({"b1": F.pmod(F.shiftrightunsigned(order, 12), F.lit(BUCKETS)).cast("int"), "b2": F.pmod(order, F.lit(BUCKETS)).cast("int"), "order": order})


def edge(rows: DataFrame, bucket: str, need: DataFrame) -> DataFrame:
    """The bucket of each pattern in which its need ends (BUCKETS: in none), and what is then still needed."""
    sums = rows.groupBy("pattern", bucket).agg(F.sum("size").alias("words"))
    per = sums.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct(bucket, "words"))).alias("all")).join(need, "pattern")

    def step(a: Column, x: Column) -> Column:
        ends = a["over"] | (a["left"] < x["words"])
        return F.struct(F.when(a["over"], a["at"]).otherwise(x[bucket]).alias("at"), F.when(ends, a["left"]).otherwise(a["left"] - x["words"]).alias("left"), ends.alias("over"))

    start = F.struct(F.lit(-1).alias("at"), F.col("need").alias("left"), F.lit(False).alias("over"))
    walk = per.select("pattern", F.aggregate("all", start, step).alias("w"))
    return walk.select("pattern", F.when(F.col("w.over"), F.col("w.at")).otherwise(F.lit(BUCKETS)).alias("cut"), F.col("w.left").alias("need"))


def local(spark: SparkSession, rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> DataFrame:
    """A small table from the driver, of a size that Spark knows."""
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)]
    return spark.createDataFrame(pa.table(columns, names=list(names)))


PATTERN = pa.list_(pa.string())


def marks(sized: DataFrame, rates: list[tuple], seed: int) -> list[tuple]:
    """Per pattern: (pattern, whole repeats, first bucket, second bucket, last order, last row, whether partly) up to which a document comes once more.

    Rows of one order (same key and text) are one item of that many copies; where the need ends within an item, its
    first rows are taken, counted partition by partition."""
    spark = sized.sparkSession
    rows = ordered(sized, seed)
    need = local(spark, [(p, rest) for p, _, rest in rates], ("pattern", "need"), (PATTERN, pa.float64()))

    def table(found: list) -> DataFrame:
        return local(spark, [(r["pattern"], r["cut"], r["need"]) for r in found], ("pattern", "cut", "need"), (PATTERN, pa.int32(), pa.float64()))

    first = edge(rows, "b1", need).collect()
    on_edge = cut(rows.join(table(first), "pattern").where(F.col("b1") == F.col("cut")).drop("cut", "need"))
    second = edge(on_edge, "b2", table(first).drop("cut")).collect()
    last = on_edge.join(table(second), "pattern").where(F.col("b2") == F.col("cut"))
    items = last.groupBy("pattern", "order", "need").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.when(F.col("words") == 0, F.col("n")).otherwise(F.least(F.floor((F.col("need") - before) * F.col("n") / F.col("words") + 0.5), F.col("n")))
    taken = items.withColumn("fits", F.when(F.col("need") >= before, fits).otherwise(0)).where("fits > 0")
    ends = cut(taken.groupBy("pattern").agg(F.max(F.struct("order", "fits", "n")).alias("x")).select("pattern", "x.order", "x.fits", "x.n"))

    # the row within the last item: its partition by the partitions' counts, then its place there
    tied = rows.join(F.broadcast(ends), ["pattern", "order"]).withColumn("part", F.shiftright("row_id", 33))  # one row a pattern, as the tables above
    held = tied.groupBy("pattern", "part", "fits").agg(F.count("*").alias("k"))
    ahead = F.coalesce(F.sum("k").over(Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spot = held.withColumn("left", F.col("fits") - ahead).where("left > 0 and left <= k").select("pattern", "part", "left")
    place = F.row_number().over(Window.partitionBy("pattern", "part").orderBy("row_id"))
    final = tied.join(F.broadcast(spot), ["pattern", "part"]).withColumn("i", place).where(F.col("i") == F.col("left")).select("pattern", "order", "row_id").collect()
    c1, c2 = ({tuple(r["pattern"]): r["cut"] for r in found} for found in (first, second))
    at = {tuple(r["pattern"]): (r["order"], r["row_id"]) for r in final}
    return [(p, whole, c1.get(tuple(p), -1), c2.get(tuple(p), -1), *(at.get(tuple(p)) or (None, None)), rest > 0) for p, whole, rest in rates]


def repeats(rows: DataFrame, marked: list[tuple], seed: int) -> DataFrame:
    """rows (pattern, key, digest, row_id, ...) with `copies`: whole repeats of the pattern, and one more for those that come first."""
    table = local(rows.sparkSession, marked, ("pattern", "whole", "c1", "c2", "last_order", "last_row", "partly"), (PATTERN, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))
    at_last = (F.col("order") < F.col("last_order")) | ((F.col("order") == F.col("last_order")) & (F.col("row_id") <= F.col("last_row")))
    extra = (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & ((F.col("b2") < F.col("c2")) | ((F.col("b2") == F.col("c2")) & at_last)))
    copies = F.coalesce("whole", F.lit(0)) + F.coalesce(F.col("partly") & extra, F.lit(False)).cast("int")
    return ordered(rows, seed).join(table, "pattern", "left").withColumn("copies", copies).drop("b1", "b2", "order", "whole", "c1", "c2", "last_order", "last_row", "partly", "digest", "row_id")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", memberships: Column | None = None, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 17, max_patterns: int = 100_000, carry: bool = False) -> tuple[DataFrame, dict[str, dict]]:
    """Rows (pattern, key, size, copies; with carry the whole input row as struct `row`), and per source its size and target.

    memberships: array of source names; by default the document's own source. weights repeat
    over the sources in code point order."""
    own = F.array(F.coalesce(F.col("source"), F.lit(NULL)))
    held = F.array_sort(F.array_distinct(F.transform(memberships if memberships is not None else own, lambda s: F.coalesce(s, F.lit(NULL)))))
    narrow = [held.alias("pattern"), F.col(key).alias("key"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("digest")]
    whole = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    # once written, rows keep their partition and place, so row_id is theirs
    sized = cut(docs.select(*narrow, *whole)).withColumn("row_id", F.monotonically_increasing_id())
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).where("pattern is not null and size(pattern) > 0").limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; raise max_patterns")
    found.sort(key=lambda r: r["pattern"])
    sizes: dict[str, int] = {}
    for r in found:
        for s in r["pattern"]:
            sizes[s] = sizes.get(s, 0) + int(r["size"])
    names = sorted(sizes)
    words = float(sum(int(r["size"]) for r in found))
    goal = targets(sizes, {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}, most, words)
    taken = flow([frozenset(r["pattern"]) for r in found], [int(r["size"]) for r in found], goal, COSTS[:most])
    rates = []
    for r, words in zip(found, taken, strict=True):
        size = int(r["size"])
        whole = min(most, int((words + 1e-6) // size)) if size else 0
        rates.append((list(r["pattern"]), whole, float(max(0.0, words - whole * size)) if whole < most else 0.0))
    return repeats(sized, marks(sized.drop("row"), rates, seed), seed), {s: {"size": sizes[s], "target": goal[s]} for s in names}


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sources = mix(documents(spark, sf_dir))
    known = local(spark, [(s, x["size"], x["target"]) for s, x in sources.items()], ("s", "source_size", "target"), (pa.string(), pa.int64(), pa.float64()))
    rows = mixed.join(known, F.element_at("pattern", 1) == F.col("s"), "left")
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document as often as the mix takes it, none where that is never."""
    mixed, _ = mix(docs, carry=True)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
