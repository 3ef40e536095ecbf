"""Live progress: incremental counters, a bounded event log, and resumable sinks, as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dataloom.operators.events import RING


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def running_counters(events: DataFrame, by: tuple[str, ...] = ("job_id", "kind")) -> DataFrame:
    """Counts per key; commutative, so it needs no state code. For update or complete mode."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def ring_log(events: DataFrame, n: int = RING) -> DataFrame:
    """Stream of (job_id, seq, ts, kind): events numbered per job in order of arrival (time within a batch).

    State per job is the last number and the last n events, whatever the length of the log; of each batch only the
    events that the ring still holds are emitted. A job's part of a batch comes in frames of bounded size, in no order; of
    these the newest n are held.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times, kinds = state.get if state.exists else (0, [], [])
        newest, came = pd.DataFrame(), 0
        for frame in frames:
            came += len(frame)
            rows = frame[["ts", "kind"]]
            newest = (pd.concat([newest, rows]) if len(newest) else rows).sort_values(["ts", "kind"], kind="stable").tail(n)
        if not came:
            return
        last += came
        times, kinds = [*times, *(ts.value for ts in newest["ts"])][-n:], [*kinds, *newest["kind"]][-n:]
        state.update((last, list(map(int, times)), kinds))
        fresh = min(came, len(times))
        yield pd.DataFrame({"job_id": key[0], "seq": range(last - fresh + 1, last + 1), "ts": pd.to_datetime(times[-fresh:]), "kind": kinds[-fresh:]})

    rows = events.select("job_id", "ts", "kind")
    return rows.groupBy("job_id").applyInPandasWithState(
        step, f"job_id {rows.schema['job_id'].dataType.simpleString()}, seq long, ts timestamp, kind string",
        "last long, times array<long>, kinds array<string>", "append", GroupStateTimeout.NoTimeout,
    )


def publish(counters: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Starts a query that keeps a table of the latest counters: each batch replaces its version of the table, so a
    batch that is run again changes nothing. Stop it with `.stop()`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = counters.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="750 milliseconds")).start()


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of the last batch."""
    rows = spark.read.parquet(folder)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").drop("batch", "batch_id")


def snapshots(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per job, kind and time window, late events within `late` counted; for append mode."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "job_id", "kind").agg(F.count("*").alias("n"))


def drain(query_of: Callable[[], object], timeout_s: int | None = None) -> None:
    """Runs an available-now query to its end. One that is not done in time is stopped, and that is an error."""
    query = query_of()
    if not (query.awaitTermination() if timeout_s is None else query.awaitTermination(timeout_s)) and timeout_s is not None:
        query.stop()
        raise TimeoutError(f"the query did not end within {timeout_s} s")
    if query.exception():
        raise query.exception()
