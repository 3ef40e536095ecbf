"""The category loop as keyed state: a stream of judge calls, of which each category takes what it still wants.

`transformWithStateInPandas` holds per category how many attempts were made and accepted, and the attempts that came before
their turn. Attempts count in the order of their number, whatever the order in which their calls arrive, so the result is
that of `curate.seek_target` over the whole log: until `target` are accepted, or `budget` times target are made.

A call without a score has failed; a timer asks for it again after `retry_s` (of event time), up to `max_calls` calls of an attempt,
after which the attempt is rejected. A category that hears nothing for `expire_s` says so once and goes on if calls still come. State is
in RocksDB and the checkpoint, so a restarted query goes on where it was; a finished category keeps its tally alone.

Input: (category string, attempt int, call int, score int, target int, ts timestamp). Output, in append mode: (category, attempt, event,
call, score, accepted, made): event 'made' with the outcome of an attempt, 'retry' with the call to make, 'done' and 'expired'; accepted and
made are the category's so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "category string, attempt int, event string, call int, score int, accepted int, made int"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Seek(StatefulProcessor):
    """One category's accept and reject, call by call."""

    def __init__(self, threshold: int, budget: int = 5, max_calls: int = 3, retry_s: int = 60, expire_s: int = 3600):
        self.threshold, self.budget, self.max_calls = threshold, budget, max_calls
        self.retry_ms, self.expire_ms = retry_s * 1000, expire_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # expire_at, 0 for none: a timer that is not the latest one says nothing
        self.tally = handle.getValueState("tally", "made int, accepted int, target int, done boolean, expire_at long")
        # calls of attempts that have no outcome or whose turn has not come: (score, when to ask again, 0 for never)
        self.open = handle.getMapState("open", "attempt int, call int", "score int, retry_at long")

    def close(self) -> None:
        pass

    def _outcome(self, calls: dict[int, tuple]) -> tuple[bool, int, int | None] | None:
        """(accepted, call, score) of an attempt, once its calls decide it."""
        last = None
        for call in range(1, self.max_calls + 1):
            if call not in calls:
                return None
            score = calls[call][0]
            if score is not None and score >= self.threshold:
                return True, call, score
            last = score if score is not None else last
        return False, self.max_calls, last

    def _advance(self, key: tuple, tally: list, open_: dict[int, dict[int, tuple]], now_ms: int) -> list[tuple]:
        """Takes attempts in order while they are decided; asks again for what failed and is due."""
        out = []
        while not tally[3] and (calls := open_.get(tally[0] + 1)) is not None and (outcome := self._outcome(calls)) is not None:
            tally[0] += 1
            tally[1] += outcome[0]
            out.append((key[0], tally[0], "made", outcome[1], outcome[2], tally[1], tally[0]))
            del open_[tally[0]]
            if tally[1] >= tally[2] or tally[0] >= self.budget * tally[2]:
                tally[3] = True
                open_.clear()
                out.append((key[0], tally[0], "done", None, None, tally[1], tally[0]))
        for attempt, calls in sorted(open_.items()):
            for call, (score, retry_at) in sorted(calls.items()):
                if retry_at and retry_at <= now_ms:
                    calls[call] = (score, 0)
                    out.append((key[0], attempt, "retry", call + 1, None, tally[1], tally[0]))
        return out

    def _loaded(self) -> tuple[list, dict[int, dict[int, tuple]]]:
        tally = list(self.tally.get()) if self.tally.exists() else [0, 0, 0, False, 0]
        open_: dict[int, dict[int, tuple]] = {}
        if self.tally.exists() and not tally[3]:
            for (attempt, call), (score, retry_at) in self.open.iterator():
                open_.setdefault(attempt, {})[call] = (score, retry_at)
        return tally, open_

    def _stored(self, tally: list, before: dict, after: dict) -> None:
        self.tally.update(tuple(tally))
        old = {(a, c): v for a, calls in before.items() for c, v in calls.items()}
        new = {(a, c): v for a, calls in after.items() for c, v in calls.items()}
        for k in old.keys() - new.keys():
            self.open.removeKey(k)
        for k, v in new.items():
            if old.get(k) != v:
                self.open.updateValue(k, v)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tally, open_ = self._loaded()
        if tally[3]:
            for _ in rows:
                pass
            return
        before = {a: dict(calls) for a, calls in open_.items()}
        latest = 0
        for frame in rows:
            score_of = frame["score"].astype("object").where(frame["score"].notna(), None)
            for attempt, call, score, target, ts in zip(frame["attempt"], frame["call"], score_of, frame["target"], frame["ts"]):
                tally[2], at = int(target), ts.value // 1_000_000
                latest = max(latest, at)
                if attempt <= tally[0] or call > self.max_calls:
                    continue
                failed = score is None
                retry_at = at + self.retry_ms if failed and call < self.max_calls else 0
                open_.setdefault(int(attempt), {})[int(call)] = (None if failed else int(score), retry_at)
        # a later call answers the one before it
        for calls in open_.values():
            for call in calls:
                if call + 1 in calls:
                    calls[call] = (calls[call][0], 0)
        now = timerValues.getCurrentWatermarkInMs()
        out = self._advance(key, tally, open_, now)
        for calls in open_.values():
            for _, retry_at in calls.values():
                if retry_at:
                    self.handle.registerTimer(retry_at)
        if not tally[3]:
            tally[4] = max(tally[4], latest + self.expire_ms)
            self.handle.registerTimer(tally[4])
        self._stored(tally, before, open_)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"call": "Int32", "score": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tally, open_ = self._loaded()
        if tally[3]:
            return
        before = {a: dict(calls) for a, calls in open_.items()}
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = self._advance(key, tally, open_, at)
        if at == tally[4]:
            out.append((key[0], None, "expired", None, None, tally[1], tally[0]))
        self._stored(tally, before, open_)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"attempt": "Int32", "call": "Int32", "score": "Int32"})


def sought(calls: DataFrame, threshold: int, budget: int = 5, max_calls: int = 3, retry_s: int = 60, expire_s: int = 3600, late: str = "1 hour") -> DataFrame:
    """The stream of what the category loop makes of a stream of judge calls; see the module.

    The session's state store is set to RocksDB, which this kind of state needs. Calls older than `late` behind the
    newest do not move the clock back, and are not dropped.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = calls.select("category", F.col("attempt").cast("int"), F.col("call").cast("int"), F.col("score").cast("int"), F.col("target").cast("int"), "ts")
    keyed = rows.withWatermark("ts", late).groupBy("category")
    return keyed.transformWithStateInPandas(Seek(threshold, budget, max_calls, retry_s, expire_s), OUT, "Append", "EventTime")
