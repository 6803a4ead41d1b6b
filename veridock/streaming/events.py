"""Structured Streaming forms of the event log: state projection, windows, idempotent append, transitions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veridock.operators.eventlog import RESUME_TARGETS, TERMINAL, TRANSITIONS


def stream_current_state(events: DataFrame, group: str, order: str, state: str) -> DataFrame:
    """Last state per group, for update or complete mode."""
    return events.groupBy(group).agg(F.max_by(state, order).alias(state), F.max(order).alias(order))


def stream_unique(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Idempotent append: repeats of a key within the watermark are dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def stream_windows(events: DataFrame, at: str, delay: str, size: str, slide: str, *keys: str) -> DataFrame:
    """Counts and sums per sliding window; late rows beyond the watermark are left out."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def stream_sessions(events: DataFrame, at: str, delay: str, gap: str, key: str) -> DataFrame:
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))


def _legal(previous: str | None, following: str, kind: str) -> bool:
    if previous is None:
        return kind == "TRANSITION" and following == "RECEIVED"
    if previous in TERMINAL:
        return False
    if previous == "BLOCKED":
        return kind == "RESUME" and following in RESUME_TARGETS
    return kind == "TRANSITION" and following in TRANSITIONS.get(previous, [])


def stream_transitions(events: DataFrame, patience_ms: int | None = 600_000) -> DataFrame:
    """Per event (run_id, sequence, next_state, kind): accepted or not, given the run's state so far.

    An event that arrives before its predecessors waits in the run's state until
    they are there. If nothing of the run arrives for ``patience_ms``, what waits is
    not accepted; 0 doesn't wait at all, None waits for good. A query that ends when
    all is read (availableNow) takes 0 or None, as a timeout keeps a query running.
    Repeats of a sequence number that was accepted or waits are not accepted.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, last, text = state.get if state.exists else (None, 0, "[]")
        waiting = {seq: (following, kind) for seq, following, kind in json.loads(text)}

        def frame(rows: list[tuple[int, str, bool]]) -> pd.DataFrame:
            return pd.DataFrame([(key[0], *r) for r in rows], columns=["run_id", "sequence", "next_state", "accepted"])

        def refused() -> list[tuple[int, str, bool]]:
            rows = [(seq, following, False) for seq, (following, _) in sorted(waiting.items())]
            waiting.clear()
            return rows

        if state.hasTimedOut:
            yield frame(refused())
        else:
            for batch in batches:
                out = []
                for seq, following, kind in zip(batch["sequence"].tolist(), batch["next_state"], batch["kind"], strict=True):
                    if seq <= last or seq in waiting:
                        out.append((seq, following, False))
                    else:
                        waiting[seq] = (following, kind)
                while last + 1 in waiting:
                    following, kind = waiting.pop(last + 1)
                    ok = _legal(current, following, kind)
                    out.append((last + 1, following, ok))
                    if not ok:
                        break
                    current, last = following, last + 1
                yield frame(out)
            if patience_ms == 0:
                yield frame(refused())
        state.update((current, last, json.dumps([(seq, *rest) for seq, rest in sorted(waiting.items())])))
        if waiting and patience_ms:
            state.setTimeoutDuration(patience_ms)

    return events.groupBy("run_id").applyInPandasWithState(
        advance, "run_id string, sequence long, next_state string, accepted boolean", "state string, last long, waiting string", "append",
        GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout,
    )
