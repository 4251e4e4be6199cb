"""Hash-chained logs: appending, verifying, folding events into state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "0" * 64


def entry_hash(previous: Column, run: Column, seq: Column, payload: Column) -> Column:
    """sha256 over previous hash, run, number and payload, each on its own line."""
    return F.sha2(F.concat_ws("\n", previous, run.cast("string"), seq.cast("string"), payload), 256)


def chain(df: DataFrame, run: str, seq: str, payload: str) -> DataFrame:
    """df with prev_hash and hash: each entry's hash goes into the next one's.

    A run's entries pass one by one, in order, through the task that has them; none of its entries are held."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, START
        for batch in batches:
            before, hashes = [], []
            for r, s, p in zip(*[batch.column(c).to_pylist() for c in ("_run", seq, payload)], strict=True):
                last = START if r != of else last
                of = r
                before.append(last)
                last = hashlib.sha256("\n".join([last, *[x for x in (r, None if s is None else str(s), p) if x is not None]]).encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (run, seq, payload)], pa.array(before, pa.string()), pa.array(hashes, pa.string())], [run, seq, payload, "prev_hash", "hash"])

    kinds = dict(df.dtypes)
    rows = df.select(run, seq, payload, F.col(run).cast("string").alias("_run")).repartition(run).sortWithinPartitions(run, seq, payload)
    return rows.mapInArrow(links, f"{run} {kinds[run]}, {seq} {kinds[seq]}, {payload} {kinds[payload]}, prev_hash string, hash string")


def verify(df: DataFrame, run: str, seq: str, payload: str) -> DataFrame:
    """run, entries, first_bad (number of the first entry whose hash, link or number is wrong, else null), ok.

    Every entry is checked against its neighbour alone, in one window."""
    w = Window.partitionBy(run).orderBy(seq)
    right = (F.col("hash") == entry_hash(F.col("prev_hash"), F.col(run), F.col(seq), F.col(payload))) & (F.col("prev_hash") == F.coalesce(F.lag("hash").over(w), F.lit(START))) & ((F.col(seq) == F.lag(seq).over(w) + 1) | F.lag(seq).over(w).isNull())
    checked = df.withColumn("_ok", F.coalesce(right, F.lit(False)))
    out = checked.groupBy(run).agg(F.count("*").alias("entries"), F.min(F.when(~F.col("_ok"), F.col(seq))).alias("first_bad"))
    return out.withColumn("ok", F.col("first_bad").isNull())


#: What an event does to a run's status; ledger entries never change it.
STATUS = {"user": "running", "assistant": "answered", "system": "planned"}


def fold_runs(events: DataFrame, run: str, seq: str, event: str, payload: str) -> DataFrame:
    """run, status (of the last event that sets one), last_seq, n_events, first and last payload."""
    status = F.coalesce(*[F.when(F.col(event) == e, s) for e, s in STATUS.items()])
    return events.groupBy(run).agg(
        F.max_by(status, F.when(status.isNotNull(), F.col(seq))).alias("status"), F.max(seq).alias("last_seq"), F.count("*").alias("n_events"), F.min_by(payload, seq).alias("first_payload"), F.max_by(payload, seq).alias("last_payload"),
    )


def since(events: DataFrame, run: str, seq: str, of: int, after: int) -> DataFrame:
    """Events of one run after a number, in order."""
    return events.where((F.col(run) == of) & (F.col(seq) > after)).orderBy(seq)
