"""Rate limits by windows anchored at a key's first event, in batch and as a stream.

A window opens with the first event of a key and lasts a fixed time; the first event after it opens the next one. Neither tumbling nor session
windows express this, so a key's events are folded in order; a key with very many events is folded in batches that carry two numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "opened double, count long"


def fold(times: np.ndarray, opened: float | None, count: int, seconds: float, most: int) -> tuple[np.ndarray, float | None, int]:
    """(allowed, opened, count) after the ascending times of one key."""
    allowed = np.zeros(len(times), bool)
    at = 0
    while at < len(times):
        if opened is None or times[at] >= opened + seconds:
            opened, count = float(times[at]), 0
        stop = int(np.searchsorted(times, opened + seconds, side="left"))
        allowed[at:stop] = np.arange(count + 1, count + 1 + stop - at) <= most
        count += stop - at
        at = stop
    return allowed, opened, count


def anchored_decisions(events: DataFrame, key: str, ts: str, tiebreak: str, seconds: float, most: int) -> DataFrame:
    """(key, tiebreak, allowed): which events a limit of `most` in a window of `seconds` lets through. Rows are streamed in key order; no key is held whole."""
    rows = events.select(F.col(key).alias("key"), F.col(tiebreak).alias("id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    out = rows.select("key", "id").schema.add("allowed", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened, count = None, None, 0
        for batch in batches:
            keys, times = batch.column("key").to_numpy(zero_copy_only=False), np.asarray(batch.column("at"))
            allowed = np.zeros(len(times), bool)
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if keys[a] != current:
                    current, opened, count = keys[a], None, 0
                allowed[a:b], opened, count = fold(times[a:b], opened, count, seconds, most)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(allowed)], ["key", "id", "allowed"])

    sorted_rows = rows.where("key is not null and at is not null").repartition("key").sortWithinPartitions("key", "at", "id")
    return sorted_rows.mapInArrow(run, out).withColumnsRenamed({"key": key, "id": tiebreak})


def anchored_stream(events: DataFrame, key: str, seconds: float, most: int) -> DataFrame:
    """The same over a stream with columns key and at (seconds): (key, at, allowed), with a key's window as state that is dropped an hour after its last event."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        times = np.sort(pd.concat(list(frames))["at"].to_numpy())
        allowed, opened, count = fold(times, opened, count, seconds, most)
        state.update((opened, count))
        state.setTimeoutDuration(int(max(seconds, 3600) * 1000))
        yield pd.DataFrame({"key": k[0], "at": times, "allowed": allowed})

    return events.select(F.col(key).alias("key"), "at").groupBy("key").applyInPandasWithState(step, "key long, at double, allowed boolean", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
