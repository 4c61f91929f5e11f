"""The embed job log: de-duplication, per-tenant order, retention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docfathom.functions.documents import interval, older_than
from docfathom.operators.spread import rank_within, sent_if_small
from docfathom.schemas import DEDUP_WINDOW, JOB_RETENTION

# Ids with more jobs than this are walked in several pieces at once.
HOT_JOBS = 1_000_000
# Length of a piece, in de-duplication windows.
PIECE_WINDOWS = 24
BEFORE_ALL = -(1 << 62)


def dedup_jobs(
    jobs: DataFrame,
    key: str = "document_id",
    ts: str = "ts",
    window: str = DEDUP_WINDOW,
    hot_jobs: int = HOT_JOBS,
) -> DataFrame:
    """Accepted jobs, one row ``(key, ts)`` each.

    A job is dropped if it comes less than ``window`` after the last *accepted*
    job with the same key, so each decision hangs on the one before it.

    Most keys have few jobs and are walked in time order by the task that holds
    them. A key with more than ``hot_jobs`` is cut into pieces of time: every
    piece first works out, for each moment the key could become free again
    within its first window, which job would be its last accepted one; chaining
    those answers gives each piece its real starting point, and the pieces are
    then walked side by side.
    """
    width = window_micros(window)
    if width <= 0:
        raise ValueError("the window has to be longer than nothing")
    times = jobs.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    hot = times.groupBy(key).count().filter(F.col("count") > hot_jobs).select(key)
    hot = sent_if_small(hot, F.octet_length(F.col(key).cast("string")))
    calm = (
        times.join(hot, key, "left_anti")
        .repartition(key)
        .sortWithinPartitions(key, "us")
        .mapInArrow(_walk_sorted(width), times.schema)
    )
    # Equal times collapse, so a piece holds at most one row per clock tick.
    pieces = (
        times.join(hot, key, "left_semi")
        .distinct()
        .withColumn("piece", F.col("us") - F.pmod("us", F.lit(width * PIECE_WINDOWS)))
    )
    accepted = calm.unionByName(_walk_pieces(pieces, key, width))
    return accepted.select(key, F.timestamp_micros("us").alias(ts))


def window_micros(window: str) -> int:
    return int(pd.Timedelta(window) / pd.Timedelta(microseconds=1))


def accept_times(times: np.ndarray, width: int, last: int = BEFORE_ALL) -> list[int]:
    """Accepted ones of some sorted times, given the last accepted before them."""
    taken = []
    at = int(np.searchsorted(times, last + width))
    while at < len(times):
        last = int(times[at])
        taken.append(last)
        at = int(np.searchsorted(times, last + width))
    return taken


def _walk_sorted(width: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, BEFORE_ALL
        for batch in batches:
            keep = []
            for key, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != current:
                    current, last = key, BEFORE_ALL
                accept = us >= last + width
                if accept:
                    last = us
                keep.append(accept)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return walk


def _walk_pieces(pieces: DataFrame, key: str, width: int) -> DataFrame:
    key_type = pieces.schema[key].dataType.simpleString()

    def answers(rows: pd.DataFrame) -> pd.DataFrame:
        """Last accepted time for every way to enter this piece of one key.

        Row ``(enter, leave)``: entering at any moment up to ``enter``, and past
        the row before, the piece's last accepted job is the one at ``leave``.
        """
        times = np.sort(rows["us"].to_numpy())
        following = np.searchsorted(times, times + width)
        leave = times.copy()
        for at in range(len(times) - 1, -1, -1):
            if following[at] < len(times):
                leave[at] = leave[following[at]]
        # A key is free at the latest one window into the piece; the first job
        # from then on is the last one that can be entered at.
        start = int(rows["piece"].iloc[0])
        head = slice(0, int(np.searchsorted(times, start + width)) + 1)
        enter, leave = times[head], leave[head]
        last_of_run = np.append(leave[1:] != leave[:-1], True)
        return pd.DataFrame(
            {
                key: rows[key].iloc[0],
                "piece": rows["piece"].iloc[0],
                "enter": enter[last_of_run],
                "leave": leave[last_of_run],
            }
        )

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """The last job accepted before each piece of one key."""
        last, before = BEFORE_ALL, []
        for piece, ways in rows.sort_values(["piece", "enter"]).groupby("piece", sort=True):
            before.append((rows[key].iloc[0], piece, last))
            way = int(np.searchsorted(ways["enter"].to_numpy(), last + width))
            if way < len(ways):
                last = int(ways["leave"].iloc[way])
        return pd.DataFrame(before, columns=[key, "piece", "last"])

    def walk(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        taken = accept_times(np.sort(rows["us"].to_numpy()), width, int(entry["last"].iloc[0]))
        return pd.DataFrame({key: rows[key].iloc[0], "us": taken})

    ways = pieces.groupBy(key, "piece").applyInPandas(
        answers, f"{key} {key_type}, piece bigint, enter bigint, leave bigint"
    )
    entries = ways.groupBy(key).applyInPandas(chain, f"{key} {key_type}, piece bigint, last bigint")
    return (
        pieces.groupBy(key, "piece")
        .cogroup(entries.groupBy(key, "piece"))
        .applyInPandas(walk, f"{key} {key_type}, us bigint")
    )


def tenant_fifo(
    jobs: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), chunk: str = "hour"
) -> DataFrame:
    """Number each tenant's jobs in delivery order; a task sorts one ``chunk``."""
    return rank_within(jobs, "tenant_id", order, F.date_trunc(chunk, F.col(order[0])), "position")


def expired_jobs(jobs: DataFrame, as_of: Column, retention: str = JOB_RETENTION) -> DataFrame:
    return jobs.filter(older_than(F.col("ts"), as_of, retention))
