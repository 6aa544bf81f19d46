"""Structured Streaming: windows with watermarks, deduplication within a lifetime, and task states with timers.

Every function takes a streaming or a batch DataFrame with ts; `drain` runs a stream over what its source holds
and returns what the sink got.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinegraph.operators.tasks import step
from cinegraph.plans.shared import shared_dir


def tumbling(events: DataFrame, width: str, lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str, lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session(events: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def dedupe(events: DataFrame, keys: list[str], lifetime: str) -> DataFrame:
    """The first event of each key within the lifetime."""
    return events.withWatermark("ts", lifetime).dropDuplicatesWithinWatermark(keys)


def task_states(events: DataFrame, idle_ms: int | None = 1_800_000) -> DataFrame:
    """Each task's state after every batch (user_id, ts, event_id, action), kept across batches; an executor that idles past the watchdog fails.

    Without idle_ms there is no watchdog: a stream that is drained and stopped has no time to idle.
    """
    counters = "state string, analyze_attempt int, analyze_retry int, commit_attempt int, commit_retry int, rejected int"
    names = [x.split()[0] for x in counters.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, 0, 0, 0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            now = ({"ANALYZING": "ANALYZE_FAILED", "COMMITTING": "COMMIT_FAILED"}.get(now[0], now[0]), *now[1:])
        else:
            for action in pd.concat(list(batches)).sort_values(["ts", "event_id"])["action"]:
                now = step(now, action)
            state.update(now)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], **{n: [v] for n, v in zip(names, now, strict=True)}})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("user_id").applyInPandasWithState(run, f"user_id long, {counters}", counters, "update", timeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that its source holds, into the shared folder, and reads the result."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")  # by number: a repeated batch replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", path).parquet(path).select(stream.columns)
