"""Streams of events: windows, late data, first-seen rows, folded state. Each has a batch twin of the same code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of event files with a proper timestamp."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def event_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *[c for c in df.columns if c != "w"])


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, end, event_type, n, total."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return _bounds(marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def sliding(events: DataFrame, size: str = "6 hours", step: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return _bounds(marked.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most")))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """start, end, user_id, n: stretches of a user's events with no longer gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return _bounds(marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")))


def first_seen(events: DataFrame, keys: list[str], late: str = "10 days") -> DataFrame:
    """The first row of each key; in a stream, state is kept as long as late rows may come."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def breaker(events: DataFrame, failures: int = 3, open_seconds: int = 60) -> DataFrame:
    """user_id, event_id, state before each call, of a circuit breaker a user: closed, open after so many failures in a row
    (calls are refused), half_open once so many seconds have passed (one probe decides)."""

    def step(state: tuple, bad: bool, at: float) -> tuple[tuple, str]:
        mode, count, since = state
        if mode == "open" and at - since >= open_seconds:
            mode = "half_open"
        seen = mode
        if mode == "open":
            return (mode, count, since), seen
        if not bad:
            return ("closed", 0, 0.0), seen
        count += 1
        return (("open", count, at) if mode == "half_open" or count >= failures else ("closed", count, 0.0)), seen

    def fold(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        ordered = rows.sort_values(["ts", "event_id"])
        seen = []
        for kind, at in zip(ordered["event_type"], ordered["ts"].astype("int64") / 1e9, strict=True):
            state, name = step(state, kind == "error", float(at))
            seen.append(name)
        return state, pd.DataFrame({"user_id": ordered["user_id"], "event_id": ordered["event_id"], "state": seen})

    schema = "user_id long, event_id long, state string"
    def passing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, state = None, None
        for frame in frames:
            for user, part in frame.groupby("user_id", sort=False, dropna=False):  # a user's rows come together, in order
                state, out = fold(state if user == of else ("closed", 0, 0.0), part)
                of = user
                yield out

    if not events.isStreaming:
        rows = events.select("user_id", "event_id", "event_type", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
        return rows.mapInPandas(passing, schema)

    def stateful(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = fold(state.get if state.exists else ("closed", 0, 0.0), pd.concat(list(batches)))
        state.update(now)
        yield out

    return events.groupBy("user_id").applyInPandasWithState(stateful, schema, "mode string, count long, since double", "append", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs over all that is there and gives the rows put out."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
