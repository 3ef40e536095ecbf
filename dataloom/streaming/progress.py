"""Live progress: counters that Spark takes while it works, published as rows of a small table.

A batch is observed (`observed`), a stream by a listener (`follow`): in both the figures come with the work, nothing is counted again.
Every row has a number, an event ('progress', 'keepalive' where nothing came in, 'done' at the end), a status, and the
figures so far. A row is one file that appears at once; a reader that has seen number n asks for what follows.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from dataloom.sources.versions import Taken, _Files

ROW = "seq long, event string, status string, figures map<string,long>"


class ProgressLog:
    """Rows of progress in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, self.path)

    def _last(self) -> int:
        return max((int(n[:-5]) for n in self._files.names(self.path) if n.endswith(".json")), default=0)

    def figures(self) -> dict[str, int]:
        """The figures of the last row."""
        last = self._last()
        return json.loads(self._files.text(f"{self.path}/{last:010d}.json"))["figures"] if last else {}

    def put(self, event: str, status: str, figures: dict[str, int]) -> int:
        while True:
            seq = self._last() + 1
            try:
                self._files.put_new(f"{self.path}/{seq:010d}.json", json.dumps({"seq": seq, "event": event, "status": status, "figures": figures}))
                return seq
            except Taken:
                continue

    def wait_for_end(self, after: int = 0, timeout_s: float = 60.0) -> None:
        """Returns once the last row is 'done' and follows number `after`; a listener is told of a query's end a little after it."""
        until = time.monotonic() + timeout_s
        while True:
            last = self._last()
            if last > after and json.loads(self._files.text(f"{self.path}/{last:010d}.json"))["event"] == "done":
                return
            if time.monotonic() > until:
                raise TimeoutError("no end of the query was told")
            time.sleep(0.1)

    def after(self, seq: int = 0) -> DataFrame:
        """Rows that follow number `seq`, in order."""
        rows = self.spark.read.schema(ROW).json(self.path) if self._last() else self.spark.createDataFrame([], ROW)
        return rows.where(F.col("seq") > seq).orderBy("seq")


class Watched:
    """A batch whose figures are there when an action has read it."""

    def __init__(self, rows: DataFrame, log: ProgressLog, figures: dict[str, Column]):
        self._log, self._observation = log, Observation()
        self.rows = rows.observe(self._observation, *[c.alias(n) for n, c in figures.items()])

    def done(self, status: str = "completed") -> int:
        """Publishes the figures; to be called after the action, else it waits for it."""
        return self._log.put("done", status, {n: int(v or 0) for n, v in self._observation.get.items()})


def observed(rows: DataFrame, log: ProgressLog, figures: dict[str, Column]) -> Watched:
    return Watched(rows, log, figures)


class _Follower(StreamingQueryListener):
    def __init__(self, log: ProgressLog, name: str):
        self.log, self.name = log, name
        self.runs: set = set()
        self.figures = log.figures()  # a query that goes on adds to what was published

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        if event.progress.name != self.name:
            return
        found = event.progress.observedMetrics.get(self.name)
        if found is None or not event.progress.numInputRows:
            self.log.put("keepalive", "running", self.figures)
            return
        for n, v in found.asDict().items():
            self.figures[n] = self.figures.get(n, 0) + int(v or 0)
        self.log.put("progress", "running", self.figures)

    def onQueryIdle(self, event) -> None:
        if str(event.runId) in self.runs:
            self.log.put("keepalive", "running", self.figures)

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self.log.put("done", "failed" if event.exception else "completed", self.figures)


def follow(stream: DataFrame, log: ProgressLog, name: str, figures: dict[str, Column]) -> tuple[DataFrame, StreamingQueryListener]:
    """The stream with counters, and the listener (added to the session) that publishes their sums; start the query under this name.

    Figures are of what a micro-batch read, counts and sums, and add up over them. Remove the listener when the query has ended.
    """
    listener = _Follower(log, name)
    stream.sparkSession.streams.addListener(listener)
    return stream.observe(name, *[c.alias(n) for n, c in figures.items()]), listener
