"""What several operators share: Arrow text buffers, hashes and checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: An odd multiplier and its inverse modulo 2**64.
P = 0x9E3779B97F4A7C15
P_INV = pow(P, -1, 1 << 64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there.

    The folder is spark.checkpoint.dir. Where that is unset, a local master (tests) gets a
    temporary one; on a cluster it is an error, as a machine's own folder goes with the machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()


#: So many keys of the most rows can be hot, from so many rows on; all other keys hold less than 1/HOT of the rows each.
HOT, FEW = 1000, 512


def hot_keys(counts: DataFrame, on: Sequence[str], n: str = "n") -> list[tuple[int, int]]:
    """(hash, parts) of the HOT keys with the most rows, of those with more than FEW: a part holds no more rows than the least of them, or FEW.

    counts: one row a key with its number of rows n. What reaches the driver is at most HOT pairs of numbers."""
    found = counts.where(F.col(n) > FEW).select(F.xxhash64(*on).alias("key"), F.col(n).alias("n")).orderBy(F.desc("n")).limit(HOT).collect()
    each = max(FEW, found[-1]["n"] if len(found) == HOT else 0)
    return [(r["key"], min(HOT, -(-r["n"] // each))) for r in found]


def spread_join(many: DataFrame, one: DataFrame, on: Sequence[str], hot: list[tuple[int, int]], by: Sequence[str], how: str = "inner") -> DataFrame:
    """many joined with one (a row a key) where a key's rows in many are split into its parts, so no task gets a hot key whole.

    by: columns of many that tell a key's rows apart. Only the hot keys' numbers are broadcast; of `one`, the rows of hot keys are repeated."""
    if not hot:
        return many.join(one, list(on), how)
    most: dict[int, int] = {}
    for k, p in hot:
        most[k] = max(p, most.get(k, 0))
    few = F.broadcast(many.sparkSession.createDataFrame(pa.table({"_key": pa.array(list(most), pa.int64()), "_parts": pa.array(list(most.values()), pa.int32())})))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.withColumn("_key", F.xxhash64(*on)).join(few, "_key", "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_key", "_parts")
    right = one.withColumn("_key", F.xxhash64(*on)).join(few, "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_key", "_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


#: Bits a key of a filter, and the most bits of one: at most 1/64 as many numbers are broadcast.
BITS, MOST_BITS = 8, 1 << 25


def key_filter(keys: DataFrame, on: str) -> tuple[DataFrame, int]:
    """(words of 64 bits with the bits of the keys' hashes, number of bits): of bounded size; what doesn't fit lets more rows pass, never fewer."""
    size = min(MOST_BITS, 1 << max(6, (BITS * keys.count()).bit_length()))
    at = keys.select(F.pmod(F.xxhash64(on), F.lit(size)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return at.groupBy(F.shiftright("at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), size


def may_hold(rows: DataFrame, on: str, words: DataFrame, size: int, name: str) -> DataFrame:
    """rows with a boolean `name`: false only where the filter surely doesn't hold the key. No row is moved."""
    at = F.pmod(F.xxhash64(on), F.lit(size))
    known = rows.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word", "left")
    return known.withColumn(name, F.expr("coalesce(shiftright(_bits, cast(_at & 63 as int)) & 1L, 0L) = 1L")).drop("_at", "_word", "_bits")


def remainder(doc_id: str, n: int):
    """crc32 of doc_id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("long"))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end (null: empty), and the rows' n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts with about `most` bytes of text each; a row is never split."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        row = 0
        while row < batch.num_rows:
            done = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(row, stop - row)
            row = stop
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((P, P_INV)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span: polynomial sums from one running sum."""
    up, down = powers(len(values) + 1)
    v = (values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(32)
    sums = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v * up[: len(v)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(P))


#: 1 for the ASCII white space that parts words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of other than ASCII white space, and the number of runs in each row."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[raw]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = inside[0], False
    np.logical_and(inside[1:], ~inside[:-1], out=edge[1:n])
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    edge[first] = inside[first]
    starts = np.flatnonzero(edge)
    stop = np.empty(n, bool)
    stop[n - 1] = inside[n - 1]
    np.logical_and(inside[:-1], ~inside[1:], out=stop[: n - 1])
    last = first[1:] - 1
    stop[last] = inside[last]
    ends = np.flatnonzero(stop) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and the number of words in each row."""
    starts, ends, counts = words(raw, offsets)
    return span_hashes(_LOWER[raw], starts, ends), counts
