"""Nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Largest inner product is smallest distance after one dimension is added that brings every
candidate to the same norm; vectors are then turned by a seeded random rotation and kept in
column blocks. Lists come from k-means on a bounded sample; every vector goes to its nearest
list. Within a probed list, vectors are taken in growing steps; after each column block a
hypothesis test compares the partial distance, scaled to all dimensions, with the best k-th
distance so far, and candidates that are too far with high confidence are abandoned. What is
left is scored exactly, in double precision on the original vectors.

Each query probes its nearest lists: as many as held the share `recall` of the k best when the
bounded sample was searched by brute force, and as many more as it takes to hold `reserve`
candidates. Large lists are parted into chunks, and the queries of a much probed
list into blocks, so that no task holds more than a bounded number of either. Recall against brute
force is measured in the tests and given in the README.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
null ids; vectors of another length than the most common one take no part either; rows that repeat an id count once (the
smallest vector); fewer than k candidates are all returned; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

BLOCK, EPSILON, SAMPLE, CHUNK, QUERIES = 16, 2.1, 20_000, 4096, 2048
#: Vectors of the sample that give each query its first bound; vectors taken at a time; share of pairs below which pairs are looked at singly.
SEEDS, STEP, SPARSE = 4096, 512, 0.05


@dataclass
class Index:
    turn: np.ndarray  # (dims + 1 padded, dims + 1 padded) rotation
    centres: np.ndarray  # in rotated space
    norm2: float  # largest squared norm
    seeds: np.ndarray | None = None  # rotated vectors of the sample, and their ids
    seed_ids: np.ndarray | None = None

    def rotate(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rotated vectors with the added dimension, padded to whole blocks."""
        wide = np.zeros((len(x), len(self.turn)))
        wide[:, : x.shape[1]] = x
        if not query:
            wide[:, x.shape[1]] = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return wide @ self.turn

    def bounds(self, y: np.ndarray, ids: np.ndarray, order: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
        """Squared distance within which a query has k vectors at least, by the seeds in its first lists; infinite with too few."""
        if len(self.seeds) <= k:
            return np.full(len(y), np.inf)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
        home = self.distances(self.seeds).argmin(axis=1)
        d = (y * y).sum(axis=1)[:, None] + (self.seeds * self.seeds).sum(axis=1)[None] - 2 * y @ self.seeds.T
        d[(ids[:, None] == self.seed_ids[None]) | (place[:, home] >= number[:, None])] = np.inf
        return np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0) * (1 + 1e-9) + 1e-12

    def distances(self, y: np.ndarray) -> np.ndarray:
        return (self.centres * self.centres).sum(axis=1) - 2 * y @ self.centres.T


def train(sample: np.ndarray, norm2: float, lists: int, seed: int = 5) -> Index:
    """Rotation and k-means centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    size = -(-(sample.shape[1] + 1) // BLOCK) * BLOCK
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    index = Index(turn, np.zeros((0, size)), norm2)
    y = index.rotate(sample, False)
    centres = y[rng.choice(len(y), min(lists, len(y)), replace=False)]
    for _ in range(8):
        near = ((centres * centres).sum(axis=1) - 2 * y @ centres.T).argmin(axis=1)
        sums = np.stack([np.bincount(near, y[:, d], len(centres)) for d in range(size)], axis=1)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    index.centres = centres
    return index


def enough_probes(index: Index, sample: np.ndarray, k: int, recall: float, queries: int = 400) -> int:
    """Nearest lists that hold the share `recall` of the k best of a query, measured by brute force within the sample."""
    some = sample[:queries]
    score = some @ sample.T
    score[np.arange(len(some)), np.arange(len(some))] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    home = index.distances(index.rotate(sample, False)).argmin(axis=1)
    rank = index.distances(index.rotate(some, True)).argsort(axis=1).argsort(axis=1)
    ranks = np.take_along_axis(rank, home[best], axis=1)
    return int(np.quantile(ranks, recall)) + 1 if ranks.size else 1


def scan(vectors: np.ndarray, turned: np.ndarray, ids: np.ndarray, queries: np.ndarray, turned_q: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of what is left of one list's chunk: the k best of each query, ids ascending in the chunk."""
    n, size, nq = len(turned), turned.shape[1], len(turned_q)
    bound = bound.copy()
    best_d = np.full((nq, k), np.inf)
    kept_q, kept_v = [], []
    slack = 1e-12 * float(max((turned * turned).sum(axis=1).max(), 1e-300))
    blocks = [slice(b, b + BLOCK) for b in range(0, size, BLOCK)]

    def far(done: int) -> float:
        """Factor on the best distance above which a candidate of so many dimensions is abandoned."""
        return (done / size) * (1 + EPSILON / np.sqrt(done)) ** 2 if done < size else 1.0

    for at in range(0, n, STEP):
        some = turned[at : at + STEP]
        dense, b = np.zeros((nq, len(some))), 0
        while b < len(blocks):  # all pairs of a column block at once, as long as many are left
            x, q = some[:, blocks[b]], turned_q[:, blocks[b]]
            dense += (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T
            b += 1
            near = dense <= (bound * far(BLOCK * b) + slack)[:, None]
            if near.mean() < SPARSE:
                break
        qi, vi = np.nonzero(near)
        d = dense[qi, vi]
        while b < len(blocks):  # then only the pairs that are left
            diff = some[:, blocks[b]][vi] - turned_q[:, blocks[b]][qi]
            d += np.einsum("ij,ij->i", diff, diff)
            b += 1
            keep = d <= bound[qi] * far(BLOCK * b) + slack
            qi, vi, d = qi[keep], vi[keep], d[keep]
        own = query_ids[qi] == ids[at + vi]
        qi, vi, d = qi[~own], vi[~own], d[~own]
        kept_q.append(qi)
        kept_v.append(vi + at)
        order = np.lexsort((d, qi))
        sorted_q = qi[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        near = rank < k
        new = np.full((nq, k), np.inf)
        new[sorted_q[near], rank[near]] = d[order][near]
        best_d = np.partition(np.concatenate([best_d, new], axis=1), k - 1, axis=1)[:, :k]
        bound = np.minimum(bound, best_d.max(axis=1))
    qi, vi = np.concatenate(kept_q), np.concatenate(kept_v)
    score = np.empty(len(qi))
    for s in range(0, len(qi), 1 << 16):
        score[s : s + (1 << 16)] = (vectors[vi[s : s + (1 << 16)]] * queries[qi[s : s + (1 << 16)]]).sum(axis=1)
    order = np.lexsort((ids[vi], -score, qi))
    qi, vi, score = qi[order], vi[order], score[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    return qi[rank < k], vi[rank < k], score[rank < k]


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: one finite, non-zero vector of the most common length per id."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("id").agg(F.min("v").alias("v"))


def neighbours(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, lists: int | None = None, probes: int | None = None, recall: float = 0.97, reserve: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for every id divisible by `every`."""
    spark = df.sparkSession
    rows = cut(clean(df, key, vector))
    n, norm2 = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    # by a threshold on the id's hash, so no task sends more than its share
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(np.ceil(min(1.0, SAMPLE / n) * (1 << 30)))).limit(SAMPLE).collect()
    picked = [picked[i] for i in np.random.default_rng(3).permutation(len(picked))] if len(picked) > 1 else rows.limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in picked])
    lists = lists or int(np.clip(np.sqrt(n), 1, 4096))
    index = train(sample, norm2, lists)
    index.seeds, index.seed_ids = index.rotate(sample[:SEEDS], False), np.array([r["id"] for r in picked[:SEEDS]])
    lists = len(index.centres)
    probes = probes or enough_probes(index, sample, k, recall)
    shared = spark.sparkContext.broadcast(index)  # at most 4,096 centres, 4,096 seeds and one rotation

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("id"), np.array(batch.column("v").to_pylist())
            if len(x):
                y = shared.value.rotate(x, False)
                near = shared.value.distances(y).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in y])], ["id", "list", "v", "t"])

    placed = cut(rows.mapInArrow(assign, "id long, list int, v binary, t binary"))
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    chunks = np.maximum(1, -(-sizes // CHUNK))
    least = max(probes, 1)
    enough = reserve or 50 * k

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            ids, x = batch.column("id").to_numpy(), np.array(batch.column("v").to_pylist())
            if not len(x):
                continue
            y = shared.value.rotate(x, True)
            order = shared.value.distances(y).argsort(axis=1)
            held = np.cumsum(sizes[order], axis=1)
            number = np.maximum(least, 1 + (held < enough).sum(axis=1)).clip(max=lists)
            row = np.repeat(np.arange(len(x)), number)
            found = order[row, np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)]
            row, found = row[sizes[found] > 0], found[sizes[found] > 0]
            raw, turned = [r.tobytes() for r in x], [r.tobytes() for r in y]
            bound = shared.value.bounds(y, ids, order, number, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found.astype(np.int32)), pa.array(bound[row]), pa.array([raw[i] for i in row], pa.binary()), pa.array([turned[i] for i in row], pa.binary())], ["id", "list", "bound", "v", "t"])

    asked = rows.where(F.pmod("id", F.lit(every)) == 0).mapInArrow(probe, "id long, list int, bound double, v binary, t binary")
    asking = n // every * (least / lists) + 1
    blocks = np.maximum(1, np.ceil(asking * np.maximum(sizes / max(sizes.mean(), 1), 1) / QUERIES).astype(np.int64))
    known = spark.sparkContext.broadcast((chunks.tolist(), blocks.tolist()))  # two numbers a list
    parts = spark.createDataFrame(pa.table({"list": pa.array(range(lists), pa.int32()), "chunks": pa.array(known.value[0]), "blocks": pa.array(known.value[1])}))
    stored = placed.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", "t")
    wanted = asked.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), "blocks").alias("block"), "id", "bound", "v", "t")

    def search(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(want):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        have = have.sort_values("id")
        ids, query_ids = have["id"].to_numpy(), want["id"].to_numpy()
        matrix = lambda c, kind: np.frombuffer(b"".join(c), kind).reshape(len(c), -1)
        qi, vi, score = scan(matrix(have["v"], np.float64), matrix(have["t"], np.float64), ids, matrix(want["v"], np.float64), matrix(want["t"], np.float64), query_ids, want["bound"].to_numpy(), k)
        return pd.DataFrame({"query_id": query_ids[qi], "vec_id": ids[vi], "score": score})

    place = ["list", "chunk", "block"]
    found = wanted.groupBy(place).cogroup(stored.groupBy(place)).applyInPandas(lambda want, have: search(have, want), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
