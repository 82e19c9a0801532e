"""Event streams: interval counts, sessions, deduplication, pacing and heartbeats, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_time(events: DataFrame, time: str = "ts") -> DataFrame:
    """Watermarks want a timestamp with zone; a naive one is read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def read_events(spark: SparkSession, path: str, files_a_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; files_a_trigger holds back what one batch takes."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return event_time(reader.parquet(path))


def tumbling(events: DataFrame, by: list[str], seconds: int = 60, late: str = "2 minutes", time: str = "ts") -> DataFrame:
    """Counts and sums of value in intervals."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, by: list[str], length: str = "10 seconds", step: str = "1 second", late: str = "2 minutes", time: str = "ts") -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(F.window(time, length, step), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grouped.select(F.col("window.start").alias("start"), *by, "n", "mean")


def sessions(events: DataFrame, key: str, gap: str, late: str = "2 minutes", time: str = "ts") -> DataFrame:
    """Runs of a key's events without such a gap; where one ends, the key was silent for that long."""
    grouped = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup(events: DataFrame, key: list[str], ttl: str, time: str = "ts") -> DataFrame:
    """The first event of a key for ttl."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark(key)


class FirstSighting(StatefulProcessor):
    """Passes an event unless its key was passed within seconds before; repeats do not extend that time. Of equal times the event of the smallest tie passes. Wants event time: once the watermark is past that time, the key's state goes.

    A batch of a key takes as many steps as events pass, not as it holds.
    """

    def __init__(self, seconds: float, time: str = "ts", tie: str | None = None) -> None:
        self.seconds, self.time, self.tie = seconds, time, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values([self.time] + [self.tie] * (self.tie is not None), kind="stable")
        times = found[self.time].to_numpy("datetime64[us]").astype(np.int64)
        step = round(self.seconds * 1e6)
        at = int(np.searchsorted(times, pd.Timestamp(self.passed.get()[0]).as_unit("us").asm8.astype(np.int64) + step)) if self.passed.exists() else 0
        keep = []
        while at < len(times):
            keep.append(at)
            at = max(at + 1, int(np.searchsorted(times, times[at] + step)))
        if keep:
            last = found[self.time].iloc[keep[-1]]
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((pd.Timestamp(last).timestamp() + self.seconds) * 1000))
            self.passed.update((pd.Timestamp(last).to_pydatetime(),))
        yield found.iloc[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def bucket(part: pd.DataFrame, tokens: float, at: float | None, rate: float, capacity: float, time: str) -> tuple[list[bool], float, float | None]:
    """Token bucket over a key's events in order of time: which pass, and what is left when."""
    allowed = []
    for t in part[time]:
        now = t.timestamp()
        tokens = capacity if at is None else min(capacity, tokens + max(0.0, now - at) * rate)
        at = now if at is None else max(at, now)
        allowed.append(tokens >= 1)
        tokens -= tokens >= 1
    return allowed, tokens, at


def rate_limit(events: DataFrame, key: str, rate: float, capacity: float, time: str = "ts") -> DataFrame:
    """events (a stream) with allowed: a bucket of capacity tokens for each key, filled at rate a second."""
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes) + ", allowed boolean"

    def run(_key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (capacity, None)
        found = pd.concat(list(parts)).sort_values(time)
        found["allowed"], tokens, at = bucket(found, tokens, at, rate, capacity, time)
        state.update((tokens, at))
        yield found

    return events.groupBy(key).applyInPandasWithState(run, schema, "tokens double, at double", "append", "NoTimeout")


def rate_limit_batch(events: DataFrame, key: str, rate: float, capacity: float, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The same over a table: rows are hashed by key and sorted, and a task remembers one bucket."""
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes) + ", allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, at = object(), capacity, None
        for part in batches:
            allowed: list[bool] = []
            for k, group in part.groupby(key, sort=False, dropna=False):
                if k != current:
                    current, tokens, at = k, capacity, None
                one, tokens, at = bucket(group, tokens, at, rate, capacity, time)
                allowed += one
            yield part.assign(allowed=allowed)

    return events.repartition(key).sortWithinPartitions(key, time, tie).mapInPandas(run, schema)


def heartbeats(beats: DataFrame, worker: str, now, timeout: float = 90.0, grace: float = 60.0, time: str = "ts") -> DataFrame:
    """Workers by their last beat: alive, suspect after timeout seconds, dead after grace more."""
    last = beats.groupBy(worker).agg(F.max(time).alias("last_beat"))
    silent = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(F.col("last_beat").cast("timestamp")) / 1e6
    return last.withColumn("state", F.when(silent > timeout + grace, "dead").when(silent > timeout, "suspect").otherwise("alive"))


class Failover(StatefulProcessor):
    """A worker is suspect when no beat came for timeout, dead when none came for grace more; a beat brings it back. Emits changes."""

    def __init__(self, timeout: float, grace: float, time: str = "ts") -> None:
        self.timeout, self.grace, self.time = timeout, grace, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "state string, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = int(max(part[self.time].max().timestamp() for part in rows) * 1000)
        state, before = self.seen.get() if self.seen.exists() else (None, 0)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = max(last, before)
        self.handle.registerTimer(last + int(self.timeout * 1000))
        self.seen.update(("alive", last))
        if state != "alive":
            yield pd.DataFrame({"worker": [key[0]], "state": ["alive"], "at_ms": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last = self.seen.get()
        new = "suspect" if state == "alive" else "dead"
        if new == "suspect":
            self.handle.registerTimer(last + int((self.timeout + self.grace) * 1000))
        self.seen.update((new, last))
        yield pd.DataFrame({"worker": [key[0]], "state": [new], "at_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def pace(requests: DataFrame, key: str, most: int, seconds: int, time: str = "ts") -> DataFrame:
    """How many requests of a key a time window holds, and whether that is over what is allowed."""
    counted = requests.groupBy(key, F.window(time, f"{seconds} seconds").start.alias("start")).agg(F.count("*").alias("n"))
    return counted.withColumn("over", F.col("n") > most)


def with_retries(process, dead_letters: str, most: int = 5):
    """A foreachBatch function that calls process(batch, id) up to most times, then appends the batch to the dead letters with the error."""

    def run(batch: DataFrame, batch_id: int) -> None:
        error = None
        for _ in range(most):
            try:
                return process(batch, batch_id)
            except Exception as e:  # noqa: BLE001 - whatever it was, it is written down
                error = e
        batch.withColumn("error", F.lit(f"{type(error).__name__}: {error}")).withColumn("batch_id", F.lit(batch_id)).withColumn("attempts", F.lit(most)).write.mode("append").parquet(dead_letters)
        return None

    return run


def overflow(queue: DataFrame, capacity: int, policy: str = "drop") -> tuple[DataFrame, int]:
    """What a full queue keeps, and how many rows are dropped; policy raise refuses."""
    n = queue.count()
    if n <= capacity:
        return queue, 0
    if policy == "raise":
        raise OverflowError(f"{n} rows for {capacity}")
    return queue.orderBy("priority", "seq").limit(capacity), n - capacity
