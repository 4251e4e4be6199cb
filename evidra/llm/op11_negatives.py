"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Components become whole numbers, floor(scale * x), so every score is an exact integer. One more dimension brings each row
to the largest norm; then a row's distance to an anchor falls as its inner product with the anchor rises
(d**2 = M + |q|**2 - 2 * score), a window of scores is an annulus around the anchor, and higher scores are nearer.

The upper tree is fitted on at most SAMPLE rows and leads every row to a leaf; the distances of all of a leaf's rows to the
vantage points above it are measured, and bound what a leaf can hold for an anchor. A leaf's rows are grouped in tasks of a
bounded number, each with a lower tree of its own, where anchors go down together: first into the child that is nearer,
then, with the windows that the rows found so far have narrowed, into the other if the annulus still meets it.
An anchor is first sent to the nearest leaves that meet its annuli, up to RESERVE rows; the k-th score found there narrows
the annuli, and only leaves that still meet one are asked after that. Nothing is left out: the answers are those of comparing all rows.

The positives are such a search in the annulus of everything, within the label; then one search serves all windows of an anchor.

Edge cases: rows whose id, label or vector is null, or that hold a null or non-finite component, take no part; shorter vectors are filled up
with zeros (an empty one is all zeros); rows that repeat an id count once (smallest label, then vector); ties go to the smaller id; an anchor
without positives or without rows in a window has no lines; squared norms above 2**50 are an error, as scores would not be exact; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows a leaf should hold and levels of the upper tree, rows of its sample; rows of a lower tree's bucket; rows and anchors in a task; rows that the first leaves hold.
LEAF, LEVELS, SAMPLE, BUCKET, CHUNK, QUERIES, RESERVE = 1024, 12, 20_000, 128, 2048, 2048, 4096
LARGEST = 1 << 50
#: Distances are rounded: bounds are taken this much wider.
SLACK = 1e-7


def vantage_point(x: np.ndarray, rng: np.random.Generator) -> tuple[int, np.ndarray]:
    """The row of a few random ones whose distances to the others spread most, and those distances."""
    best = (-1.0, 0, np.zeros(len(x)))
    for i in rng.choice(len(x), min(5, len(x)), replace=False):
        d = np.sqrt(np.maximum(((x - x[i]) ** 2).sum(axis=1), 0))
        best = max(best, (float(d.std()), int(i), d), key=lambda b: b[0])
    return best[1], best[2]


@dataclass
class Upper:
    """A full binary tree of vantage points (children of i: 2i + 1 within the radius, 2i + 2 beyond it) and what its leaves hold."""

    top: int  # largest squared norm
    kind: str  # type of stored components
    levels: int
    points: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray | None = None  # rows of each leaf
    low: np.ndarray | None = None  # smallest and largest distance of a leaf's rows to the vantage point of each level
    high: np.ndarray | None = None

    def wide(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def read(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column), self.kind).reshape(len(column), -1).astype(np.float64)

    def lead(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, and its distances to the vantage points on the way."""
        y, node, path = self.wide(x), np.zeros(len(x), np.int64), np.zeros((len(x), self.levels))
        for level in range(self.levels):
            path[:, level] = np.sqrt(((y - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + 1 + (path[:, level] > self.radii[node])
        return node - (2**self.levels - 1), path

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that a leaf's rows can have from each query."""
        y = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        leaf = np.arange(len(self.sizes))
        near, far = np.zeros((len(q), len(leaf))), np.full((len(q), len(leaf)), np.inf)
        for level in range(self.levels):
            node = 2**level - 1 + (leaf >> (self.levels - level))
            nodes, which = np.unique(node, return_inverse=True)
            p = self.points[nodes]
            d = np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * y @ p.T, 0))[:, which]
            near = np.maximum(near, np.maximum(d - self.high[:, level], self.low[:, level] - d))
            far = np.minimum(far, d + self.high[:, level])
        return near, far


def fit(sample: np.ndarray, top: int, kind: str, levels: int, seed: int = 11) -> Upper:
    rng = np.random.default_rng(seed)
    tree = Upper(top, kind, levels, np.zeros((2**levels - 1, sample.shape[1] + 1)), np.full(2**levels - 1, np.inf))
    wide = tree.wide(sample)
    held = {0: np.arange(len(sample))}
    for node in range(2**levels - 1):
        rows = held.pop(node, np.zeros(0, np.int64))
        if len(rows):
            at, d = vantage_point(wide[rows], rng)
            tree.points[node], tree.radii[node] = wide[rows[at]], np.median(d)
            held[2 * node + 1], held[2 * node + 2] = rows[d <= tree.radii[node]], rows[d > tree.radii[node]]
    return tree


class Lower:
    """The vantage-point tree of one task's rows, and the search of many windows in it."""

    def __init__(self, upper: Upper, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.x, self.ids, self.labels, self.wide, self.points = x, ids, labels, upper.wide(x), []
        self.rng = np.random.default_rng(len(x))
        self.root = self.grow(np.arange(len(x)))

    def grow(self, rows: np.ndarray):
        """A bucket of rows, or (number of the vantage point, ((least, largest distance, child) of the inner half, of the outer half))."""
        if len(rows) <= BUCKET:
            return rows
        at, d = vantage_point(self.wide[rows], self.rng)
        if d.max() == 0:
            return rows
        split = min(np.median(d), np.nextafter(d.max(), 0))
        number = len(self.points)
        self.points.append(self.wide[rows[at]])
        return number, [(d[s].min(), d[s].max(), self.grow(rows[s])) for s in (d <= split, d > split)]

    def search(self, top: int, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row, score) of rows with low <= score <= high, at least the k first of each window. owner: the query of each window."""
        norm = top + (q * q).sum(axis=1)
        inner = np.sqrt(np.maximum(norm[owner] - 2 * high, 0))
        low, best = low.copy(), np.full((len(owner), k), -np.inf)
        y = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        points = np.array(self.points).reshape(-1, y.shape[1])
        away = np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * y @ points.T, 0))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def bucket(rows: np.ndarray, some: np.ndarray) -> None:
            asked, at = np.unique(owner[some], return_inverse=True)
            score = (q[asked] @ self.x[rows].T)[at]
            match = (labels[asked][:, None] == self.labels[rows][None]) == same
            fits = (match & (ids[asked][:, None] != self.ids[rows][None]))[at]
            fits &= (score >= low[some, None]) & (score <= high[some, None])
            w, r = np.nonzero(fits)
            if len(w):
                found.append((some[w], rows[r], score[w, r]))
                full = np.concatenate([best[some], np.where(fits, score, -np.inf)], axis=1)
                best[some] = np.partition(full, -k, axis=1)[:, -k:]
                low[some] = np.maximum(low[some], best[some].min(axis=1))

        def meets(child, number: int, some: np.ndarray) -> np.ndarray:
            d = away[owner[some], number]
            outer = np.sqrt(np.maximum(norm[owner[some]] - 2 * low[some], 0))
            return some[(np.maximum(d - child[1], child[0] - d) <= outer * (1 + SLACK) + SLACK) & ((d + child[1]) * (1 + SLACK) + SLACK >= inner[some])]

        def visit(node, some: np.ndarray) -> None:
            if not len(some):
                return
            if isinstance(node, np.ndarray):
                bucket(node, some)
                return
            number, halves = node
            d = away[owner[some], number]
            least = [np.maximum(np.maximum(d - h[1], h[0] - d), inner[some]) for h in halves]
            within = (least[0] < least[1]) | ((least[0] == least[1]) & (d <= halves[0][1]))
            for mine in (within, ~within), (~within, within):
                for half, chosen in zip(halves, mine, strict=True):
                    visit(half[2], meets(half, number, some[chosen]))

        visit(self.root, np.arange(len(owner)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        w, r, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((self.ids[r], -s, w))
        w, r, s = w[order], r[order], s[order]
        first = np.arange(len(w)) - np.searchsorted(w, w) < k
        return w[first], r[first], s[first]


def clean(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label, v: one vector of whole numbers per id."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = F.exists(x, lambda c: F.abs(c) * scale > float(LARGEST) ** 0.5)
    v = F.when(large, F.raise_error(F.lit("a squared norm is above 2**50"))).otherwise(F.transform(x, lambda c: F.floor(c * scale)))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def fdiv(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long")


WINDOWS = "array<struct<no:long,first:long,low:long,high:long>>"
FOUND = "id long, no long, found long, score long"


class Forest:
    """All rows by leaves and chunks of leaves, and searches in them."""

    def __init__(self, rows: DataFrame):
        """rows: id, label, v of clean()."""
        self.spark = spark = rows.sparkSession
        rows = cut(rows)
        norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
        large = F.array_max(F.transform("v", lambda c: F.greatest(c, -c - 1)))
        n, top, most, size = rows.agg(F.count("*"), F.max(norm), F.max(large), F.max(F.size("v"))).first()
        if n and top > LARGEST:
            raise ValueError("a squared norm is above 2**50")
        self.n, self.size = n, size or 0
        kind = next(t for t in ("<i2", "<i4", "<i8") if (most or 0) < 1 << (8 * int(t[2]) - 1))
        picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(np.ceil(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))).limit(SAMPLE).select("v").collect()
        sample = np.zeros((len(picked), self.size))
        for i, r in enumerate(picked):
            sample[i, : len(r["v"])] = r["v"]
        levels = int(np.clip(np.ceil(np.log2(max(n, 1) / LEAF)), 0, LEVELS)) if len(sample) else 0
        tree = fit(sample, top or 0, kind, levels)
        shared, width = spark.sparkContext.broadcast(tree), self.size  # at most 2**LEVELS - 1 vectors

        def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column("v").to_pylist()
                x = np.zeros((len(v), width))
                for i, row in enumerate(v):
                    x[i, : len(row)] = row
                if len(x):
                    leaf, path = shared.value.lead(x)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in x.astype(kind)]), pa.array(leaf.astype(np.int32)), pa.array(list(path), pa.list_(pa.float64()))], ["id", "label", "v", "leaf", "path"])

        placed = cut(rows.mapInArrow(lead, "id long, label long, v binary, leaf int, path array<double>"))
        self.rows = placed.drop("path")
        held = 2**levels
        tree.sizes, tree.low, tree.high = np.zeros(held, np.int64), np.full((held, levels), np.inf), np.full((held, levels), -np.inf)
        sides = [f(F.get("path", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(levels) for f in (F.min, F.max)]
        for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), *sides).collect():  # 2**LEVELS rows at most
            tree.sizes[r["leaf"]] = r["n"]
            tree.low[r["leaf"]], tree.high[r["leaf"]] = [r[f"min{i}"] for i in range(levels)], [r[f"max{i}"] for i in range(levels)]
        self.tree, self.shared = tree, spark.sparkContext.broadcast(tree)
        self.chunks = np.maximum(1, -(-tree.sizes // CHUNK))

    def ask(self, asked: DataFrame, first: bool) -> DataFrame:
        """asked once for each leaf that an anchor's windows meet: the nearest ones up to RESERVE rows, or all the others."""
        shared = self.shared

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
                tree = shared.value
                q = tree.read(batch.column("v").to_pylist())
                near, far = tree.reach(q)
                near[:, tree.sizes == 0] = np.inf
                norm = tree.top + (q * q).sum(axis=1)
                rows, leaves = [], []
                columns = [batch.column(c).to_pylist() for c in ("first", "low", "high")]
                for i, (begin, low, high) in enumerate(zip(*columns, strict=True)):
                    inner, wide, tight = (np.sqrt(np.maximum(norm[i] - 2 * np.array(v, float), 0))[:, None] for v in (high, begin, low))
                    beyond = far[i] * (1 + SLACK) + SLACK >= inner
                    met = np.flatnonzero((beyond & (near[i] <= wide * (1 + SLACK) + SLACK)).any(axis=0))
                    order = met[np.lexsort((met, near[i][met], np.maximum(near[i][met], inner.min(initial=np.inf))))]
                    early = 1 + int(np.searchsorted(np.cumsum(tree.sizes[order]), RESERVE))
                    if first:
                        chosen = order[:early]
                    else:
                        still = (beyond & (near[i] <= tight * (1 + SLACK) + SLACK)).any(axis=0)
                        chosen = order[early:][still[order[early:]]]
                    rows.append(np.full(len(chosen), i))
                    leaves.append(chosen)
                take = pa.array(np.concatenate(rows))
                out = pa.Table.from_batches([batch]).take(take).append_column("leaf", pa.array(np.concatenate(leaves).astype(np.int32)))
                yield from out.combine_chunks().to_batches()

        return cut(asked.mapInArrow(probe, "id long, label long, v binary, no array<long>, first array<long>, low array<long>, high array<long>, leaf int"))

    def answers(self, asking: DataFrame, same: bool, k: int) -> DataFrame:
        """FOUND of every window in every leaf asked: at most k rows a window and task."""
        shared = self.shared
        blocks = np.ones(len(self.chunks), np.int64)
        for r in asking.groupBy("leaf").count().collect():  # 2**LEVELS rows at most
            blocks[r["leaf"]] = -(-r["count"] // QUERIES)
        leaf = pa.table({"leaf": pa.array(range(len(blocks)), pa.int32()), "chunks": pa.array(self.chunks), "blocks": pa.array(blocks)})
        parts = F.broadcast(self.spark.createDataFrame(leaf))
        have = self.rows.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "label", "v")
        want = asking.drop("first").join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id", "label", "v", "no", "low", "high")

        def search(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
            tree = shared.value
            if not len(have) or not len(want):
                return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("id", "no", "found", "score")})
            have = have.sort_values("id")
            lower = Lower(tree, tree.read(have["v"]), have["id"].to_numpy(), have["label"].to_numpy())
            owner = np.repeat(np.arange(len(want)), [len(w) for w in want["no"]])
            no, low, high = (np.concatenate(want[c].to_numpy()).astype(kind) for c, kind in (("no", np.int64), ("low", float), ("high", float)))
            w, r, s = lower.search(tree.top, tree.read(want["v"]), want["id"].to_numpy(), want["label"].to_numpy(), owner, low, high, same, k)
            return pd.DataFrame({"id": want["id"].to_numpy()[owner[w]], "no": no[w], "found": lower.ids[r], "score": s.astype(np.int64)})

        place = ["leaf", "chunk", "block"]
        return want.groupBy(place).cogroup(have.groupBy(place)).applyInPandas(search, FOUND)

    def nearest_first(self, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """FOUND and rank of the k first rows in every window (id, no, low, high) of the anchors (id, label, v), of their label or of any other."""

        def asked(windows: DataFrame) -> DataFrame:
            w = F.array_sort(F.collect_list(F.struct("no", "first", "low", "high")))  # as many as an anchor has positives
            grouped = anchors.join(windows.groupBy("id").agg(w.cast(WINDOWS).alias("w")), "id")
            return grouped.select("id", "label", "v", *[F.col("w").getField(c).alias(c) for c in ("no", "first", "low", "high")])

        def best(found: DataFrame) -> DataFrame:
            rank = F.row_number().over(Window.partitionBy("id", "no").orderBy(F.desc("score"), "found"))
            return found.withColumn("rank", rank).where(F.col("rank") <= k)

        windows = cut(windows.withColumn("first", F.col("low")))
        early = cut(best(self.answers(self.ask(asked(windows), True), same, k)))
        bound = early.where(F.col("rank") == k).select("id", "no", F.col("score").alias("bound"))
        narrowed = windows.join(bound, ["id", "no"], "left").withColumn("low", F.greatest("low", "bound"))
        late = self.answers(self.ask(asked(narrowed), False), same, k)
        return cut(best(early.drop("rank").unionByName(late)))


def hard_negatives(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: ids divisible by `every`. For each of an anchor's first `positives` rows of its label, the first k rows of other labels whose
    score is between low and high hundredths of that positive's."""
    forest = Forest(clean(df, key, vector, label, scale))
    anchors = forest.rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "label", "v")
    everything = anchors.select("id", F.lit(0).cast("long").alias("no"), F.lit(-LARGEST).cast("long").alias("low"), F.lit(LARGEST).cast("long").alias("high"))
    near = forest.nearest_first(anchors, everything, True, positives).select("id", F.col("found").alias("no"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    windows = near.select("id", "no", (-fdiv(-low * score, 100)).alias("low"), fdiv(high * score, 100).alias("high")).where("low <= high")
    found = forest.nearest_first(anchors, windows, False, k).join(near, ["id", "no"])
    return found.select(F.col("id").alias("anchor_id"), F.col("no").alias("positive_id"), "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", changed))


ORACLE = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
