"""Streaming twins of the stateful operators: suspicion and token buckets a key, with state that expires.

Events arrive in micro-batches; each key keeps one small state row. Within a batch a key's events are taken in event-time order; an event
older than the state counts at the state's time. A watermark bounds how late events may be, and the state of a key that is silent longer than
``expire_s`` is dropped: by then suspicion has halved often enough to be nothing, and a bucket is full again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakewarden.operators.state import ALPHA, CLEAN_RELAX, HALF_LIFE_S


def suspicion(events: DataFrame, key: str, ts: str, evidence: str, tie: str, late: str = "1 hour", alpha: float = ALPHA, half_life_s: float = HALF_LIFE_S, expire_s: float = 86_400.0) -> DataFrame:
    """(key, tie, ts, suspicion): events (``ts`` a timestamp) with their key's suspicion after them, as a stream."""
    kinds = dict(events.dtypes)

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches)).sort_values([ts, tie], kind="stable")
        out = []
        for at, e in zip(rows[ts], rows[evidence]):
            now = at.timestamp()
            s *= 2.0 ** (-max(0.0, now - last) / half_life_s) if last is not None else 1.0
            s = s * CLEAN_RELAX if pd.isna(e) else s + (1 - s) * alpha * min(1.0, max(0.0, float(e)))
            last = now if last is None else max(last, now)
            out.append(s)
        state.update((s, last))
        state.setTimeoutTimestamp(max(int((last + expire_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], tie: rows[tie].to_numpy(), ts: rows[ts].to_numpy(), "suspicion": out})

    return (
        events.select(key, ts, evidence, tie)
        .withWatermark(ts, late)
        .groupBy(key)
        .applyInPandasWithState(fold, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {ts} timestamp, suspicion double", "s double, last double", "append", GroupStateTimeout.EventTimeTimeout)
    )


def token_bucket(events: DataFrame, key: str, ts: str, tie: str, late: str = "10 minutes", capacity: float = 60.0, refill: float = 1.0) -> DataFrame:
    """(key, tie, ts, allowed, tokens_left): admission of events by a token bucket a key, as a stream."""
    kinds = dict(events.dtypes)

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values([ts, tie], kind="stable")
        allowed, left = [], []
        for at in rows[ts]:
            now = at.timestamp()
            if last is not None:
                tokens = min(capacity, tokens + max(0.0, now - last) * refill)
            ok = tokens >= 1
            tokens -= ok
            last = now if last is None else max(last, now)
            allowed.append(ok)
            left.append(tokens)
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + capacity / refill) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], tie: rows[tie].to_numpy(), ts: rows[ts].to_numpy(), "allowed": allowed, "tokens_left": left})

    return (
        events.select(key, ts, tie)
        .withWatermark(ts, late)
        .groupBy(key)
        .applyInPandasWithState(fold, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {ts} timestamp, allowed boolean, tokens_left double", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
    )
