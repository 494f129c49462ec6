"""Debounce with a maximum wait: bursts collapse into one firing after a quiet gap, or when the burst is too old.

The stream keeps per key the burst's first and last time and its size; the batch twin below defines the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIRED = "user_id long, first_ms long, last_ms long, n long"
STATE = "first_ms long, last_ms long, n long"


def fire(times: list[int], gap: int, most: int, state: tuple[int, int, int] | None) -> tuple[list[tuple[int, int, int]], tuple[int, int, int] | None]:
    """(finished bursts, open burst) after ordered times in milliseconds."""
    out = []
    for t in times:
        if state and (t - state[1] > gap or t - state[0] > most):
            out.append(state)
            state = None
        state = (state[0], t, state[2] + 1) if state else (t, t, 1)
    return out, state


def stream(events: DataFrame, gap_ms: int, most_ms: int, late: str = "1 hour") -> DataFrame:
    """Firings per user from a stream of events; a burst that stays open fires when the watermark passes its gap."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_burst = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *open_burst)], columns=["user_id", "first_ms", "last_ms", "n"])
            return
        times = sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"])
        done, open_burst = fire(times, gap_ms, most_ms, open_burst)
        if open_burst:
            state.update(open_burst)
            state.setTimeoutTimestamp(max(open_burst[1] + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *b) for b in done], columns=["user_id", "first_ms", "last_ms", "n"])

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, FIRED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def batch(events: DataFrame, gap_ms: int, most_ms: int) -> DataFrame:
    """The same firings from a table, the last burst of each user included; one user's times fit in a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        times = sorted(int(t.value // 1_000_000) for t in pdf["ts"])
        done, last = fire(times, gap_ms, most_ms, None)
        return pd.DataFrame([(int(pdf["user_id"].iloc[0]), *b) for b in [*done, *([last] if last else [])]], columns=["user_id", "first_ms", "last_ms", "n"])

    return events.where("user_id is not null and ts is not null").select("user_id", "ts").groupBy("user_id").applyInPandas(run, FIRED)
