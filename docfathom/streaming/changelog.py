"""The append-only change log that streams write and snapshots are folded from.

Layout under one root folder::

    changes/source=<ingest|embed|delete>/batch_id=<n>/   schema CHANGE, Parquet
    jobs/batch_id=<n>/                                   schema JOB, JSON lines
    rejects/batch_id=<n>/                                refused requests, Parquet

A micro-batch owns its folders and replaces them when it is run again, so
repeating it changes nothing. ``seq`` comes from the request, not from the run:
four times its arrival in microseconds, plus 2 for a delete; the outcome of
embedding a version has that version's ``seq`` plus 1. A vector made from an
older text therefore sorts before the newer ingest and cannot outlive it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docfathom.functions.documents import empty_metadata
from docfathom.operators.lifecycle import (
    apply_changes,
    document_lifecycle,
    pending_backfill,
    split_contested,
)
from docfathom.operators.spread import latest_per_key
from docfathom.schemas import BACKFILL_AGE, CHANGE, INGEST_REQUEST, PENDING
from docfathom.session import materialize

# ``tenant_id`` and ``ts`` are set by whoever receives the request, not by its sender.
REQUEST = T.StructType(
    [
        *INGEST_REQUEST.fields,
        T.StructField("tenant_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

JOB = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("text_hash", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("change_batch", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

CHANGE_PARTITIONS = T.StructType(
    [*CHANGE.fields, T.StructField("source", T.StringType()), T.StructField("batch_id", T.LongType())]
)


def changes_path(root: str, source: str, batch_id: int) -> str:
    return f"{root}/changes/source={source}/batch_id={batch_id}"


def request_seq(ts: Column, is_delete: bool = False) -> Column:
    return F.unix_micros(ts) * 4 + (2 if is_delete else 0)


def as_change(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows in the log's schema; columns not given are NULL."""
    return rows.select(
        *[
            columns.get(field.name, F.lit(None).cast(field.dataType)).alias(field.name)
            for field in CHANGE.fields
        ]
    )


def write_changes(changes: DataFrame, root: str, source: str, batch_id: int) -> None:
    changes.write.mode("overwrite").parquet(changes_path(root, source, batch_id))


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """The whole log; one that has just started anew is empty."""
    try:
        return spark.read.schema(CHANGE_PARTITIONS).parquet(f"{root}/changes")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHANGE_PARTITIONS)


def current_documents(
    spark: SparkSession, root: str, snapshot: DataFrame | None = None
) -> DataFrame:
    """Fold the log into the live documents.

    With a ``snapshot``, the log folder holds only the changes since it was
    written, and documents without changes are taken from it as they are.
    """
    changes = read_changes(spark, root)
    if snapshot is not None:
        return apply_changes(snapshot, changes)
    return document_lifecycle(split_contested(changes)[0])


def contested_changes(spark: SparkSession, root: str) -> DataFrame:
    return split_contested(read_changes(spark, root))[1]


def emit_backfill(
    documents: DataFrame, root: str, run: str, as_of: Column, age: str = BACKFILL_AGE, **options
) -> DataFrame:
    """Emit jobs again for documents pending too long, as one more job folder.

    Returns what was emitted. The same ``run`` replaces its own jobs. A document
    whose ingest is not in the log comes from the snapshot: its job has no
    ``change_batch``, and ``embed_jobs`` takes its text from there.
    """
    spark = documents.sparkSession
    # ``documents`` is often a fold of the log: it is evaluated once, for its
    # pending rows and the few columns used below (a hash, not the text).
    pending = materialize(
        documents.filter(F.col("status") == PENDING).select(
            "id", "tenant_id", "status", "created_at", "updated_at", F.md5("text").alias("text_md5")
        )
    )
    due = pending_backfill(pending, as_of, age, **options)
    ingests = read_changes(spark, root).filter("op = 'ingest'")
    newest = latest_per_key(ingests, ["id", "tenant_id"]).select(
        "id", "tenant_id", F.struct("text_hash", "seq", "batch_id").alias("logged")
    )
    # A pending document was last updated by its ingest.
    kept = F.struct(
        F.col("text_md5").alias("text_hash"),
        request_seq(F.col("updated_at")).alias("seq"),
        F.lit(None).cast("bigint").alias("batch_id"),
    )
    named = ["id", "tenant_id"]
    jobs = (
        pending.join(due.withColumnRenamed("document_id", "id"), named, "left_semi")
        .select(*named, kept.alias("kept"))
        .join(newest, named, "left")
        .withColumn("version", F.coalesce("logged", "kept"))
        .select(
            F.col("id").alias("document_id"),
            "tenant_id",
            "version.text_hash",
            "version.seq",
            F.col("version.batch_id").alias("change_batch"),
            as_of.alias("ts"),
        )
    )
    path = f"{root}/jobs/batch_id=backfill-{run}"
    jobs.write.mode("overwrite").json(path)
    return spark.read.schema(JOB).json(path)


def delete_batch(requests: DataFrame, root: str, batch_id: int) -> None:
    """Log deletes ``(document_id, tenant_id, ts)``, every one of them."""
    change = as_change(
        requests.select("document_id", "tenant_id", "ts").distinct(),
        seq=request_seq(F.col("ts"), is_delete=True),
        ts=F.col("ts"),
        op=F.lit("delete"),
        id=F.col("document_id"),
        tenant_id=F.col("tenant_id"),
    )
    write_changes(change, root, "delete", batch_id)


def ingest_change(requests: DataFrame) -> DataFrame:
    return as_change(
        requests,
        seq=request_seq(F.col("ts")),
        ts=F.col("ts"),
        op=F.lit("ingest"),
        id=F.col("document_id"),
        tenant_id=F.col("tenant_id"),
        text=F.col("text"),
        metadata=F.coalesce("metadata", empty_metadata()),
        text_hash=F.md5("text"),
    )
