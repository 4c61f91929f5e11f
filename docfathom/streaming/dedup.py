"""De-duplication of a job stream, keeping each key's last accepted time as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docfathom.operators.jobs import BEFORE_ALL, window_micros
from docfathom.schemas import DEDUP_WINDOW, JOB_RETENTION


def dedup_stream(
    jobs: DataFrame, key: str, window: str = DEDUP_WINDOW, retention: str = JOB_RETENTION
) -> DataFrame:
    """Drop a job that comes less than ``window`` after the last accepted one.

    ``jobs`` has a timestamp ``ts``. Dropping duplicates within a watermark does
    not express this: it goes by event time seen so far, not by the last
    accepted job. Here the watermark only ends a job's life: one older than
    ``retention`` is dropped, and state that no job can meet any more is freed.
    A window of no length is refused, as the batch form refuses it: nothing
    would ever be a duplicate, and the search for the next start would not move.
    """
    width = window_micros(window)
    if width <= 0:
        raise ValueError("the window has to be longer than nothing")

    def accept(
        _key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        times = rows["_us"].to_numpy()
        order = np.argsort(times, kind="stable")
        last = state.get[0] if state.exists else BEFORE_ALL
        keep = []
        at = np.searchsorted(times[order], last + width)
        while at < len(order):
            keep.append(order[at])
            last = int(times[order[at]])
            at = np.searchsorted(times[order], last + width)
        state.update((last,))
        free_at = (last + width) // 1000 + 1
        state.setTimeoutTimestamp(max(free_at, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[sorted(keep)]

    timed = jobs.withColumn("_us", F.unix_micros("ts")).withWatermark("ts", retention)
    return (
        timed.groupBy(key)
        .applyInPandasWithState(
            accept,
            timed.schema,
            "last bigint",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
        .drop("_us")
    )
