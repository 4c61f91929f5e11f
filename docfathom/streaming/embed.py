"""Continuous embedding: job, text, vector, outcome in the change log."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docfathom.operators.embedding import Embedder, embed_documents
from docfathom.schemas import (
    CHANGE,
    DEDUP_WINDOW,
    EMBED_BATCH_SIZE,
    EMBED_MAX_ATTEMPTS,
    JOB_RETENTION,
)
from docfathom.operators.lifecycle import split_contested
from docfathom.operators.spread import sent_if_small
from docfathom.streaming.changelog import JOB, as_change, changes_path, read_changes, write_changes
from docfathom.streaming.dedup import dedup_stream


def read_jobs(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """The job stream. ``max_files`` bounds what one micro-batch takes in."""
    reader = spark.readStream.schema(JOB)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(f"{root}/jobs/batch_id=*")


def logged_versions(jobs: DataFrame, root: str) -> DataFrame:
    """The document version each job was emitted for.

    Jobs name the log batch that holds their text, so only those folders are
    read: as many as there were ingest batches since the last trigger.
    """
    spark = jobs.sparkSession
    named = jobs.filter("change_batch IS NOT NULL").select("change_batch").distinct()
    # As many rows as ingest batches since the last trigger.
    batches = [row.change_batch for row in named.collect()]
    if not batches:
        return spark.createDataFrame([], CHANGE)
    paths = [changes_path(root, "ingest", batch) for batch in sorted(batches)]
    return spark.read.schema(CHANGE).parquet(*paths)


def live_jobs(jobs: DataFrame, root: str, whole_log: bool = True) -> DataFrame:
    """Jobs whose version is still the newest accepted write of their document.

    A job that a later ingest or delete of its document has overtaken would pay
    for a vector that folding throws away, so it is dropped before any text is
    fetched. With ``whole_log`` (no snapshot), writes the fold sets aside as
    another tenant's (``split_contested``, the fold's own rule) neither overtake
    a job nor are embedded. Of the log only (id, tenant_id, seq, op) of ingest
    and delete folders are read, and only for the documents of this batch,
    whose ids are counted before they are sent to the scan's tasks.
    """
    ids = sent_if_small(jobs.select(F.col("document_id").alias("id")).distinct())
    writes = (
        read_changes(jobs.sparkSession, root)
        .filter(F.col("source").isin("ingest", "delete"))
        .select("id", "seq", "op", "tenant_id")
        .join(ids, "id", "left_semi")
    )
    if whole_log:
        writes, refused = split_contested(writes)
        jobs = jobs.join(
            refused.filter(F.col("op") == "ingest").select(
                F.col("id").alias("document_id"), "seq", "tenant_id"
            ),
            ["document_id", "seq", "tenant_id"],
            "left_anti",
        )
    newest = (
        writes.groupBy("id", "tenant_id")
        .agg(F.max("seq").alias("newest"))
        .withColumnRenamed("id", "document_id")
    )
    return (
        jobs.join(newest, ["document_id", "tenant_id"], "left")
        .filter(F.col("newest").isNull() | (F.col("seq") >= F.col("newest")))
        .drop("newest")
    )


def snapshot_versions(jobs: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """(id, seq, text) of jobs without a log batch, while the snapshot has their text."""
    wanted = jobs.filter("change_batch IS NULL").select(
        F.col("document_id").alias("id"), "tenant_id", "text_hash", "seq"
    ).distinct()
    if snapshot is None:
        if not wanted.isEmpty():
            raise ValueError("jobs for documents of a snapshot need the snapshot")
        return wanted.select("id", "seq", F.lit(None).cast("string").alias("text"))
    texts = snapshot.select("id", "tenant_id", "text", F.md5("text").alias("text_hash"))
    return texts.join(wanted, ["id", "tenant_id", "text_hash"]).select("id", "seq", "text")


def embed_jobs(
    jobs: DataFrame,
    batch_id: int,
    root: str,
    embedder: Embedder,
    model: str,
    dims: int | None = None,
    batch_size: int = EMBED_BATCH_SIZE,
    partitions: int | None = None,
    fail_exhausted: bool = False,
    max_attempts: int = EMBED_MAX_ATTEMPTS,
    sleep: Callable[[float], None] = time.sleep,
    snapshot: DataFrame | None = None,
) -> None:
    """Handle one micro-batch of jobs.

    With a ``snapshot``, texts whose ingest the log no longer has come from it.

    A document that could not be embedded stays pending for the next backfill,
    or is marked failed if ``fail_exhausted``. Jobs of documents deleted or
    replaced since they were emitted cost no call (``live_jobs``); a change that
    lands while the batch runs still leaves an outcome that folding ignores.
    """
    jobs = jobs.persist()
    try:
        live = live_jobs(jobs, root, whole_log=snapshot is None)
        logged = live.filter("change_batch IS NOT NULL")
        wanted = logged.select(F.col("document_id").alias("id"), "seq").distinct()
        versions = logged_versions(jobs, root).join(wanted, ["id", "seq"], "left_semi")
        versions = versions.select("id", "seq", "text").union(snapshot_versions(live, snapshot))
        # One row per version, named by id and seq, goes through the embedder.
        named = versions.select(
            F.to_json(F.array("id", F.col("seq").cast("string"))).alias("id"), "text"
        )
        results = embed_documents(
            named,
            embedder,
            dims,
            batch_size=batch_size,
            max_attempts=max_attempts,
            spread=True,
            partitions=partitions,
            sleep=sleep,
        )
        name = F.from_json("id", "array<string>")
        results = results.withColumns({"doc": name[0], "version": name[1].cast("bigint")})
        if not fail_exhausted:
            results = results.filter("error IS NULL")
        ok = F.col("error").isNull()
        first = jobs.select("processed_at").first()
        outcome = as_change(
            results,
            seq=F.col("version") + 1,
            ts=F.lit(first.processed_at if first else None),
            op=F.when(ok, "embed_ok").otherwise("embed_fail"),
            id=F.col("doc"),
            embedding=F.col("embedding"),
            model=F.when(ok, model),
            text_hash=F.col("text_hash"),
        )
        write_changes(outcome, root, "embed", batch_id)
    finally:
        jobs.unpersist()


def start_embedding(
    jobs: DataFrame,
    root: str,
    checkpoint: str,
    embedder: Embedder,
    model: str,
    window: str = DEDUP_WINDOW,
    retention: str = JOB_RETENTION,
    dedup_by: Sequence[str] = ("document_id", "text_hash"),
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """De-duplicate a job stream and run ``embed_jobs`` on it.

    By default a changed text is a new job. With ``document_id`` alone in
    ``dedup_by`` its job is dropped within ``window``, and is left to a backfill.
    A job counts as done once its outcome is in the log: offsets commit after
    the batch is written. A repeated batch replaces its own outcomes.
    """
    # In a stream this is the time kept with the batch, the same if it is repeated.
    jobs = jobs.withColumn("processed_at", F.current_timestamp())
    keyed = jobs.withColumn("dedup_id", F.concat_ws(":", *dedup_by))
    accepted = dedup_stream(keyed, "dedup_id", window, retention).drop("dedup_id")
    return (
        accepted.writeStream.foreachBatch(
            lambda batch, batch_id: embed_jobs(batch, batch_id, root, embedder, model, **options)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
