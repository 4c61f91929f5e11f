"""Health counts and alert signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docfathom.functions.documents import interval, rfc3339
from docfathom.operators.lifecycle import pending_documents
from docfathom.schemas import (
    BACKFILL_AGE,
    BACKLOG_BUCKETS,
    BACKLOG_LIMIT,
    ERROR_RATE_LIMIT,
    P99_LIMIT_MS,
    STALE_PENDING_AGE,
)


# Steps of duration that a percentile is looked for in.
STEPS = 4096

def count_pending(corpus: DataFrame, as_of: Column, age: str) -> DataFrame:
    return pending_documents(corpus, as_of, age).agg(F.count("*").alias("n_pending"))


def count_pending_by_tenant(corpus: DataFrame, as_of: Column, age: str) -> DataFrame:
    return (
        pending_documents(corpus, as_of, age).groupBy("tenant_id").agg(F.count("*").alias("n_pending"))
    )


def backfill_summary(
    corpus: DataFrame,
    as_of: Column,
    age: str = BACKFILL_AGE,
    dry_run: bool = False,
) -> DataFrame:
    return count_pending(corpus, as_of, age).select(
        rfc3339(as_of - interval(age)).alias("cutoff"),
        F.col("n_pending").alias("total_pending"),
        (F.lit(0) if dry_run else F.col("n_pending")).cast("bigint").alias("queued"),
        F.lit(dry_run).alias("dry_run"),
    )


def signal_stale_pending(
    corpus: DataFrame, as_of: Column, age: str = STALE_PENDING_AGE
) -> DataFrame:
    return count_pending(corpus, as_of, age).withColumn("alert", F.col("n_pending") > 0)


def signal_latency_p99(
    log: DataFrame,
    width: str,
    duration: str = "duration_ms",
    limit: float = P99_LIMIT_MS,
    step: float | None = None,
) -> DataFrame:
    """Exact 99th percentile per time window, between the two nearest ranks.

    Requests without a duration have no rank and are not counted. Equal durations
    are counted, counts are summed per ``step`` of duration (by default one of
    ``STEPS`` between the least and the greatest), and only the steps that hold the
    two ranks are looked into. No task sorts a window's requests, or its distinct
    durations.
    """
    log = log.filter(F.col(duration).isNotNull())
    if step is None:
        least, most = log.agg(F.min(duration).cast("double"), F.max(duration).cast("double")).first()
        step = ((most or 0) - (least or 0)) / STEPS or 1.0
    counts = (
        log.groupBy(F.window("ts", width).start.alias("window_start"), F.col(duration).alias("took"))
        .agg(F.count("*").alias("n"))
        .withColumn("step", F.floor(F.col("took") / F.lit(step)))
    )
    in_window = Window.partitionBy("window_start")
    earlier = in_window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    place = F.lit(0.99) * (F.col("n_requests") - 1)
    steps = (
        counts.groupBy("window_start", "step")
        .agg(F.sum("n").alias("n_step"))
        .withColumns(
            {
                "n_before": F.coalesce(F.sum("n_step").over(earlier), F.lit(0)),
                "n_requests": F.sum("n_step").over(in_window),
            }
        )
        .withColumns({"low": F.floor(place), "high": F.ceil(place), "share": place - F.floor(place)})
        .filter("n_before <= high AND n_before + n_step > low")
    )
    in_step = Window.partitionBy("window_start", "step").orderBy("took")
    upto = F.col("n_before") + F.sum("n").over(
        in_step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counts.join(steps, ["window_start", "step"])
        .withColumn("upto", upto)
        .groupBy("window_start")
        .agg(
            F.max("n_requests").alias("n_requests"),
            F.max("share").alias("share"),
            F.min(F.when(F.col("upto") > F.col("low"), F.col("took"))).alias("at_low"),
            F.min(F.when(F.col("upto") > F.col("high"), F.col("took"))).alias("at_high"),
        )
        .select(
            "window_start",
            "n_requests",
            (F.col("at_low") + F.col("share") * (F.col("at_high") - F.col("at_low"))).alias("p99"),
        )
        .withColumn("alert", F.col("p99") > limit)
    )


def signal_error_rate(
    log: DataFrame, width: str, failed: str = "failed", limit: float = ERROR_RATE_LIMIT
) -> DataFrame:
    return (
        log.groupBy(F.window("ts", width).start.alias("window_start"))
        .agg(F.count("*").alias("n_calls"), F.count_if(F.col(failed)).alias("n_errors"))
        .withColumn("error_rate", F.col("n_errors") / F.col("n_calls"))
        .withColumn("alert", F.col("error_rate") > limit)
    )


def signal_backlog(
    log: DataFrame,
    width: str = "1 minute",
    change: str = "change",
    limit: int = BACKLOG_LIMIT,
    buckets: int = BACKLOG_BUCKETS,
    as_of: Column | None = None,
) -> DataFrame:
    """Queue depth at the end of each time bucket, and whether it stayed high.

    Buckets without entries are buckets too: from the first to the last that has
    any, or to that of ``as_of``. The running sum goes over one row per bucket of
    time, not over the log.
    """
    found = log.groupBy(F.window("ts", width).start.alias("window_start")).agg(F.sum(change).alias("net"))
    last = F.max("window_start") if as_of is None else F.greatest(F.max("window_start"), F.window(as_of, width).start)
    calendar = found.agg(F.min("window_start").alias("first"), last.alias("last")).filter("first IS NOT NULL")
    calendar = calendar.select(
        F.explode(F.sequence("first", "last", F.expr(f"INTERVAL {width}"))).alias("window_start")
    )
    per_bucket = calendar.join(found, "window_start", "left").withColumn(
        "net", F.coalesce("net", F.lit(0).cast("bigint"))
    )
    upto = Window.orderBy("window_start")
    recent = upto.rowsBetween(1 - buckets, 0)
    depth = per_bucket.withColumn(
        "depth", F.sum("net").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    )
    high = F.count_if(F.col("depth") > limit).over(recent) == buckets
    return depth.select("window_start", "net", "depth", high.alias("alert"))
