"""Keyed state on streams: what is seen and what a person still owes, and jobs that end or time out.

State lives in Spark's state store by key, so it is partitioned, checkpointed and restored by Spark; a restarted query emits nothing
twice. The store has to be RocksDB's (:data:`STATE_STORE`), as timers and typed states are kept there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Settings that a session needs for these operators.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

SETTLED = "record_id string, change string"
JOBS = "job_id string, status string, polls bigint, ended_at timestamp"

#: Statuses of a job that nothing follows (fixed values).
TERMINAL = ("SUCCEEDED", "FAILED", "PARTIAL_SUCCESS")
TIMED_OUT = "TIMED_OUT"


class Settling(StatefulProcessor):
    """Two states an id, kept apart as the store keeps them: whether it was ever completed, and whether a decision on it is awaited."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "since long")
        self.awaiting = handle.getValueState("awaiting", "since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = []
        frame = pd.concat(list(rows)).sort_values("sequence", kind="stable")
        for sequence, state in zip(frame["sequence"].tolist(), frame["state"].tolist(), strict=True):
            if state == "completed":
                if self.awaiting.exists():
                    self.awaiting.clear()
                    changes.append("released")
                if not self.seen.exists():
                    self.seen.update((sequence,))
                    changes.append("seen")
            elif state == "review_required" and not self.awaiting.exists():
                self.awaiting.update((sequence,))
                changes.append("awaiting")
        yield pd.DataFrame({"record_id": pd.Series([key[0]] * len(changes), dtype=object), "change": pd.Series(changes, dtype=object)})

    def close(self) -> None:
        pass


def settling(results: DataFrame) -> DataFrame:
    """``record_id, change`` of a stream (or a table) of results (``record_id, sequence, state``), when an id's standing changes and only then.

    ``seen``: completed for the first time; ``awaiting``: sent to a person, until ``released`` by a completed result; a seen id may
    be awaited again. Failed and deferred results change nothing. Rows of a batch are taken by ``sequence``.
    """
    results.sparkSession.streams.active  # noqa: B018  a table has state stores as well; their coordinator starts with the session's streams
    keyed = results.filter("record_id IS NOT NULL AND record_id <> ''").groupBy("record_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Settling(), outputStructType=SETTLED, outputMode="Append", timeMode="None")


class Polling(StatefulProcessor):
    """A job's first poll, the number of polls and its end. A timer is set at the first poll and ends a job that nothing else has ended."""

    def __init__(self, patience_seconds: int) -> None:
        self.patience = patience_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.polls = handle.getValueState("polls", "n long")
        self.ended = handle.getValueState("ended", "status string")

    def _end(self, job: str, status: str, at: pd.Timestamp) -> tuple:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.ended.update((status,))
        return job, status, self.polls.get()[0], at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        if not self.ended.exists():
            frame = pd.concat(list(rows)).sort_values("polled_at", kind="stable")
            for status, at in zip(frame["status"].tolist(), frame["polled_at"].tolist(), strict=True):
                first = not self.polls.exists()
                self.polls.update((1 if first else self.polls.get()[0] + 1,))
                if first:
                    self.handle.registerTimer(int(at.timestamp() * 1000) + self.patience)
                if status in TERMINAL:
                    out.append(self._end(key[0], status, at))
                    break
        yield _jobs(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield _jobs([] if self.ended.exists() else [self._end(key[0], TIMED_OUT, at)])

    def close(self) -> None:
        pass


def _jobs(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["job_id", "status", "polls", "ended_at"])
    return frame.astype({"job_id": object, "status": object, "polls": "int64", "ended_at": "datetime64[ns]"})


def job_ends(polls: DataFrame, *, patience_seconds: int = 600, watermark: str = "0 seconds") -> DataFrame:
    """``job_id, status, polls, ended_at``: one row a job of a stream of polls (``job_id, status, polled_at``), when it has ended.

    A job ends with its first terminal status (:data:`TERMINAL`), or as ``TIMED_OUT`` once the watermark of ``polled_at`` is
    ``patience_seconds`` past its first poll. Whatever comes of a job that has ended is ignored.
    """
    keyed = polls.withWatermark("polled_at", watermark).filter("job_id IS NOT NULL").groupBy("job_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Polling(patience_seconds), outputStructType=JOBS, outputMode="Append", timeMode="EventTime")
