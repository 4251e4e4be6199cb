"""Near-duplicate groups by BagMinHash.

A text is the multiset of its shingles of five words (A-Z lower-cased). Its signature is drawn
from Poisson processes: over every unit of a shingle's weight runs a process of rate one, whose
points fall on random components, and each component keeps its first point. The units are grouped into dyadic
intervals, (0,1], (1,2], (2,4], (4,8] and so on, that run as one process of their summed rate; a point's
bits then choose the unit within the interval, halving it again and again, and it counts if that unit lies
within the weight. Points come in order of time, so a shingle is left as soon as it is later than every
component's first point. Components of two texts agree with the probability of their
weighted Jaccard similarity, without bias.

Signatures are cut into bands. Equal texts are one node. In each bucket of a band every node is
first verified against the bucket's pivot, the node that shares most with others (exact similarity of
the multisets), and links are joined to components. Where a bucket still holds several components, all nodes outside
its largest one are compared with all others: in small buckets as pairs, in larger ones in blocks of bounded size within
a task, which puts out links only. Pairs within one component need no check, as they can't change the classes. So no link
that the bands find is lost, and groups of copies cost one comparison a node and band.

Edge cases: null counts as empty text; equal texts are always in one class; other texts without a
word are alone; texts of one to four words are a single shingle; repeated rows each get a row; class_id is the
smallest doc_id of the class (null only if all are null); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK, cut, documents, flat, hot_keys, key_filter, may_hold, mix, slices, spread_join, word_hashes

WORDS, SIMILARITY, BANDS, ROWS, BATCH = 5, 0.8, 24, 5, 1 << 20
#: Buckets of more nodes are looked at in blocks of so many.
SMALL, BLOCK = 16, 256
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: owner, hash, how often; ordered by owner, then hash."""
    h, counts = word_hashes(raw, offsets)
    first = np.concatenate([[0], np.cumsum(counts)])
    found, owners = [], []
    for size in range(1, n + 1):
        some = np.flatnonzero(counts == size if size < n else counts >= n)
        if not len(some):
            continue
        each = counts[some] - size + 1
        at = np.repeat(first[some] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
        total = np.full(len(at), np.uint64(size), np.uint64)
        for j in range(size):
            total = mix(total + h[at + j] * _STEP[j % len(_STEP)])
        found.append(total)
        owners.append(np.repeat(some, each))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, s = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])]))
    return owner[new], s[new], np.diff(np.append(new, len(s)))


def signatures(owner: np.ndarray, item: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """(rows, m) first points of BagMinHash over integer weights; rows without items stay infinite."""
    first = np.full(rows * m, np.inf)
    levels = [(owner, mix(item), weight, np.zeros(len(item), np.int64), np.ones(len(item), np.int64))]
    low = 1
    while len(some := np.flatnonzero(weight > low)):
        seed = mix(item[some] + np.uint64(low * int(_STEP[1]) & MASK))
        levels.append((owner[some], seed, weight[some], np.full(len(some), low), np.full(len(some), low)))
        low *= 2
    own, seed, most, low_, size = (np.concatenate(x) for x in zip(*levels, strict=True))
    time = np.zeros(len(own))
    j = 0
    while len(own):
        bits = mix(seed + np.uint64((2 * j + 1) * int(_STEP[0]) & MASK))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size
        place = mix(bits ^ _STEP[2])
        unit = low_ + 1 + (((place >> np.uint64(32)) * size.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        slot = own * m + ((place & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        good = unit <= most
        np.minimum.at(first, slot[good], time[good])
        last = first.reshape(rows, m).max(axis=1)
        go = time < last[own]
        own, seed, most, low_, size, time = (x[go] for x in (own, seed, most, low_, size, time))
        j += 1
    return first.reshape(rows, m)


def band_keys(first: np.ndarray, bands: int) -> np.ndarray:
    """(rows, bands) keys: a hash of each band's components and number."""
    bits = first.view(np.uint64).reshape(len(first), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(bits.shape[2]):
        key = mix(key * _STEP[0] + bits[:, :, j])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets (sorted distinct values, how often)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    every = int(a[1].sum() + b[1].sum()) - shared
    return shared / every if every else 0.0


def signed(df: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """node (digest of the text), doc_id, bands (keys; none without a word) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BATCH):
            n = part.num_rows
            first = signatures(*shingles(*flat(part.column("text"))), n, bands * rows)
            keys = band_keys(first, bands)
            has = np.isfinite(first[:, 0])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32()), pa.array(keys[has].ravel()))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("doc_id"), lists], ["node", "doc_id", "bands"])

    rows_ = with_node(df, key, text)
    return rows_.mapInArrow(run, f"node binary, doc_id {dict(rows_.dtypes)['doc_id']}, bands array<long>")


def with_node(df: DataFrame, key: str, text: str, *carry: str) -> DataFrame:
    words = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.unhex(F.md5(words.cast("binary"))).alias("node"), F.col(key).alias("doc_id"), words.alias("text"), *carry)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_a", BATCH):
            names = part.column("a").to_pylist() + part.column("b").to_pylist()
            both = pa.concat_arrays([part.column("text_a"), part.column("text_b")])
            place: dict[bytes, int] = {}
            for i, x in enumerate(names):
                place.setdefault(x, i)
            owner, item, often = shingles(*flat(both.take(pa.array(list(place.values()), pa.int64()))))
            at = np.searchsorted(owner, np.arange(len(place) + 1))
            sets = {x: (item[at[i] : at[i + 1]], often[at[i] : at[i + 1]]) for i, x in enumerate(place)}
            n = part.num_rows
            keep = [i for i in range(n) if similarity(sets[names[i]], sets[names[n + i]]) >= least]
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    t = texts.select("node", "text")
    joined = pairs
    for one, other in (("a", "b"), ("b", "a")):  # a pivot may have a third of all pairs
        hot = hot_keys(pairs.groupBy(one).agg(F.count("*").alias("n")), [one])
        joined = spread_join(joined, t.withColumnsRenamed({"node": one, "text": f"text_{one}"}), [one], hot, [other])
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def unary(owner: np.ndarray, item: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and item of a multiset as a set: the second, third, ... time of an item are items of their own."""
    level = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
    item = np.repeat(item, often)
    return np.repeat(owner, often), np.where(level > 0, mix(item + level.astype(np.uint64) * _STEP[3]), item)


def linked(left: pa.Table, right: pa.Table, least: float) -> list[tuple[bytes, bytes]]:
    """Similar pairs (loose node, node of another component): one for each loose node and component. Exact, by products of 0/1 matrices."""
    owner, item = unary(*shingles(*flat(pa.chunked_array([*left["text"].chunks, *right["text"].chunks], left["text"].type))))
    n, m = len(left), len(right)
    sizes = np.bincount(owner, minlength=n + m)
    is_left = owner < n
    columns = np.intersect1d(item[is_left], item[~is_left])
    both = np.zeros((n, m), np.float32)
    at = np.searchsorted(columns, item)
    at[at == len(columns)] = 0
    has = columns[at] == item if len(columns) else np.zeros(len(item), bool)
    owner, at = owner[has], at[has]
    for start in range(0, len(columns), 4096):
        some = (at >= start) & (at < start + 4096)
        dense = np.zeros((n + m, min(4096, len(columns) - start)), np.float32)
        dense[owner[some], at[some] - start] = 1
        both += dense[:n] @ dense[n:].T
    similar = both >= least * (sizes[:n, None] + sizes[None, n:] - both) - 1e-6
    part_a, part_b, a, b = (t[c].to_pylist() for c in ("part", "node") for t in (left, right))
    similar &= np.array(part_a, object)[:, None] != np.array(part_b, object)[None]
    found = {}
    for i, j in zip(*np.nonzero(similar), strict=True):
        found.setdefault((i, part_b[j]), (a[i], b[j]))
    return list(found.values())


def blocks(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between components within large buckets: loose nodes against all nodes, in blocks of bounded size.

    rows: bucket, node, part, main, every, loose, text. No pair leaves a task but those that are links."""
    place = F.xxhash64("node", "bucket")
    across, down = F.ceil(F.col("every") / BLOCK), F.ceil(F.col("loose") / BLOCK)
    left = rows.where("part <> main").select("bucket", F.pmod(place, down).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), across - 1)).alias("j"), "node", "part", "text")
    right = rows.select(F.col("bucket").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), down - 1)).alias("i"), F.pmod(place, across).alias("j"), *[F.col(c).alias(c) for c in ("node", "part", "text")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = linked(left, right, least) if len(left) and len(right) else []
        return pa.table({c: pa.array([x[k] for x in found], pa.binary()) for k, c in enumerate("ab")})

    key = ["bucket", "i", "j"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links lead to (smallest labels pass along links, then jump).

    A pivot with very many links, and the label of a giant class, are joined in parts."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(both.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")), ["node"])
    ends = both.withColumnRenamed("b", "node")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = spread_join(ends, labels, ["node"], hubs, ["a"]).groupBy("a").agg(F.min("label").alias("m"))
        passed = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        giants = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), ["label"])
        new = cut(spread_join(passed, over, ["label"], giants, ["node"], "left").select("node", "old", F.least("label", "next").alias("label")))
        if new.where("label <> old").isEmpty():
            return labels
        labels = new.select("node", "label")


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node, class_id, class_size (documents in it) and kept (the one that stays) of every row."""
    signs = cut(signed(docs, key, text, bands, rows))
    nodes = cut(signs.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    members = nodes.where("size(bands) > 0").select("node", F.explode("bands").alias("bucket"))

    sizes = cut(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    full = hot_keys(sizes, ["bucket"])  # buckets of so many nodes that they are joined in parts
    together = cut(spread_join(members, sizes, ["bucket"], full, ["node"]))
    # a node that shares large buckets stands in the middle of its group: the best pivot
    middle = together.groupBy("node").agg(F.sum("n").alias("middle"))
    ranked = together.drop("n").join(middle, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("middle", "node")).alias("p")).select("bucket", F.col("p.node").alias("pivot"))
    shared = cut(spread_join(ranked.select("bucket", "node"), pivots, ["bucket"], full, ["node"]))
    stars = cut(shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    needed = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
    texts = cut(_texts(docs, key, text, needed))
    links = cut(verified(stars, texts, least))
    labels = components(links)

    # buckets that still hold several components: every pair across them is looked at
    known = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("part"))
    parts = known.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("every")).where(F.col("m.n") < F.col("every"))
    about = open_.select("bucket", F.col("m.part").alias("main"), "every", (F.col("every") - F.col("m.n")).alias("loose"))
    rest = cut(spread_join(known, about, ["bucket"], full, ["node"]))
    small, large = rest.where(F.col("every") <= SMALL), rest.where(F.col("every") > SMALL)
    other = small.select("bucket", F.col("node").alias("b"), F.col("part").alias("part_b"))
    pairs = small.where("part <> main").join(other, "bucket").where("part <> part_b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    more = cut(verified(pairs, texts, least).unionByName(blocks(large.join(texts, "node"), least)))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = nodes.join(labels, "node", "left").select("node", "doc_id", "copies", F.coalesce("label", "node").alias("label"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    classes = cut(named.groupBy("label").agg(first, F.sum("copies").alias("class_size"), F.count("*").alias("n")))
    giants = hot_keys(classes, ["label"])
    by_node = spread_join(named.select("node", "label"), classes, ["label"], giants, ["node"])
    by_node = by_node.select("node", F.col("first.doc_id").alias("class_id"), (F.col("node") == F.col("first.node")).alias("head"), "class_size")
    kept = F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    rows_ = spread_join(signs.select("node", "doc_id"), by_node, ["node"], hot_keys(nodes, ["node"], "copies"), ["doc_id"])
    return rows_.select("doc_id", "node", "class_id", "class_size", kept.alias("kept"))


def _texts(docs: DataFrame, key: str, text: str, needed: DataFrame) -> DataFrame:
    """Text of each needed node, from the row with the node's smallest id: a text with many copies is not gathered.

    Rows that a filter shows to be not needed stay where they are; the join decides on the others."""
    needed = cut(needed)
    wanted = needed.select(F.col("node").alias("of"), F.col("doc_id").alias("id"))
    rows = may_hold(with_node(docs, key, text), "node", *key_filter(needed, "node"), "_may").where("_may").drop("_may")
    rows = rows.join(wanted, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return rows.select("node", "text").dropDuplicates(["node"])


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of every class, that with the smallest id (once, if its row is repeated).

    Rows that a filter shows to be alone in their class pass where they are; the others are shuffled with their texts, once."""
    found = cut(groups(docs).select("node", "doc_id", "class_size", "kept"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = with_node(docs.withColumn("_row", row), "doc_id", "text", "_row").drop("text")
    rows = may_hold(rows, "node", *key_filter(found.where("class_size > 1").select("node").distinct(), "node"), "_may")
    one = F.struct("node", "doc_id").alias("_one")  # in a struct, null ids are equal
    kept = found.where("kept").select(one).distinct()
    others = rows.where("_may").groupBy(one).agg(F.min("_row").alias("_row")).join(kept, "_one", "left_semi")
    return rows.where("not _may").select("_row.*").unionByName(others.select("_row.*"))
