"""Event-time operators that run alike on streams and on tables, and a rate limiter with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (seconds, requests) of each horizon of the limiter.
LIMITS = ((60, 60), (3600, 1000), (86400, 10000))


def typing_bursts(events: DataFrame, width: str, step: str, least: int) -> DataFrame:
    """(key, ts): sliding windows of a key with ``least`` events or more."""
    counted = events.groupBy("key", F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least).select("key", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(key, ts): runs of a key's events that are less than ``gap`` apart."""
    return events.groupBy("key", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("session_window")


def monthly_usage(events: DataFrame) -> DataFrame:
    """(key, ts, value): sums by key and month; run it on a stream in update mode."""
    return events.groupBy("key", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))


def _accept(times: list[float], log: list[float], limits=LIMITS) -> list[bool]:
    """Which requests pass, in order; a rejected one is not recorded, so it takes no room. ``log`` holds accepted ones."""
    out, longest = [], max(s for s, _ in limits)
    for t in times:
        while log and log[0] <= t - longest:
            log.pop(0)
        ok = all(sum(x > t - s for x in log) < n for s, n in limits)
        if ok:
            log.append(t)
        out.append(ok)
    return out


def rate_limit(events: DataFrame, limits=LIMITS) -> DataFrame:
    """(key, ts, id) of a table to the same and ``accepted``; a key's events in order of time and id.

    Whether one passes depends on those accepted within the longest horizon before it. A pause of that length therefore
    begins a new group. A group is sorted by Spark and streamed through one task, whose state is the log of accepted
    requests alone: at most the largest limit. A null ts is not judged.
    """
    longest = max(s for s, _ in limits)
    at = F.unix_micros("ts")
    order = Window.partitionBy("key").orderBy("ts", "id")
    begins = F.coalesce(at - F.lag(at).over(order) >= longest * 1_000_000, F.lit(False)).cast("long")
    runs = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "id").withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, log = None, []
        for batch in batches:
            keys, at, number = (batch.column(i).to_pylist() for i in (0, 3, 4))
            accepted = []
            for key, t, n in zip(keys, at, number, strict=True):
                if (key, n) != group:
                    group, log = (key, n), []
                accepted += _accept([t / 1_000_000], log, limits) if t is not None else [None]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(accepted, pa.bool_())], ["key", "ts", "id", "accepted"])

    dealt = runs.select("key", "ts", "id", at.alias("__at"), "__run").repartition("key", "__run").sortWithinPartitions("key", "__run", "ts", "id")
    return dealt.mapInArrow(run, "key long, ts timestamp, id long, accepted boolean")


def rate_limit_stream(events: DataFrame, limits=LIMITS, late: str = "1 hour") -> DataFrame:
    """The limiter over a stream: the log of accepted requests is the state of a key. It is dropped once the watermark has
    passed the longest horizon; events later than ``late`` are not judged."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    longest = max(s for s, _ in limits)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], ignore_index=True)
        rows["accepted"] = _accept([t.timestamp() for t in rows["ts"]], log, limits)
        state.update((log,))
        last = max([*log, rows["ts"].iloc[-1].timestamp()])
        state.setTimeoutTimestamp(max(int((last + longest) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[["key", "ts", "id", "accepted"]]

    keyed = events.select("key", "ts", "id").withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(run, "key long, ts timestamp, id long, accepted boolean", "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)
