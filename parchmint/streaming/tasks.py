"""Task state as a stream: the same transitions as the batch query, kept by key with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that a late task is kept past its timeout, and that an ended one is kept.
GRACE, KEEP_ENDED = 60, 60
OUTPUT = "task_id string, status string, code int, elapsed long"
STATE = "began long, last long, event string, timeout_s long"
CODES = {"complete": 200, "error": 200, "timeout": 408, "processing": 202}


def transition(state: tuple | None, event: tuple[int, str, int]) -> tuple[int, int, str, int]:
    """(began, last, event, timeout) after an event (ts, event, timeout); what has ended stays ended."""
    ts, kind, timeout = event
    if state is None:
        return ts, ts, kind, timeout
    began, last, was, limit = state
    if was in ("complete", "error") or ts < last:
        return began, last, was, limit
    return began, ts, kind, limit


def task_status(events: DataFrame) -> DataFrame:
    """events (task_id, ts timestamp, event, timeout_s) as a stream to status rows, one for each change.

    A timer says `timeout` for a task that hears nothing for its timeout and grace, and drops its
    state; an ended task's state goes after KEEP_ENDED seconds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda kind, s: pd.DataFrame([(key[0], kind, CODES[kind], int(s[1] - s[0]))], columns=["task_id", "status", "code", "elapsed"])
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if held and held[2] not in ("complete", "error"):
                yield row("timeout", held)
            return
        every = pd.concat(list(batches)).sort_values("ts")
        for ts, kind, timeout in zip(every["ts"], every["event"], every["timeout_s"], strict=True):
            held = transition(held, (int(ts.timestamp()), kind, int(timeout)))
        state.update(held)
        ended = held[2] in ("complete", "error")
        state.setTimeoutDuration((KEEP_ENDED if ended else held[3] + GRACE) * 1000)
        yield row(held[2], held)

    return events.groupBy("task_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """The last status of each task; changes: (task_id, status, code, elapsed, batch), by micro-batch."""
    last = changes.groupBy("task_id").agg(F.max_by(F.struct("status", "code", "elapsed"), "batch").alias("last"))
    return last.select("task_id", "last.status", "last.code", "last.elapsed")
