"""Continuous ingest: validate, log the change, then emit the embed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docfathom.functions.documents import ingest_reject_reason
from docfathom.operators.spread import latest_per_key, one_row_each
from docfathom.schemas import CHANGE, CORRUPT, MAX_TEXT_BYTES
from docfathom.streaming.changelog import changes_path, ingest_change, write_changes


def ingest_batch(requests: DataFrame, batch_id: int, root: str, max_bytes: int = MAX_TEXT_BYTES):
    """Handle one micro-batch of ``(document_id, tenant_id, text, metadata, ts)``.

    Every version is logged, so the fold does not depend on how requests fall into
    batches; only the last of an id and tenant gets a job. The change is written before its job: a crash in between leaves a pending
    document, which a repeated batch or a backfill picks up.
    """
    spark = requests.sparkSession
    if CORRUPT not in requests.columns:
        requests = requests.withColumn(CORRUPT, F.lit(None).cast("string"))
    reason = F.when(F.col(CORRUPT).isNotNull(), "invalid JSON").otherwise(
        ingest_reject_reason(F.col("document_id"), F.col("text"), max_bytes)
    )
    checked = requests.withColumn("reject_reason", reason).persist()
    try:
        rejected = checked.filter("reject_reason IS NOT NULL")
        rejected.write.mode("overwrite").parquet(f"{root}/rejects/batch_id={batch_id}")
        valid = ingest_change(checked.filter("reject_reason IS NULL"))
        write_changes(valid, root, "ingest", batch_id)
    finally:
        checked.unpersist()
    emit_logged_jobs(spark, root, batch_id)


def emit_logged_jobs(spark: SparkSession, root: str, batch_id: int) -> None:
    """Write the jobs of a logged batch, taken from the log itself."""
    logged = spark.read.schema(CHANGE).parquet(changes_path(root, "ingest", batch_id))
    newest = latest_per_key(logged, ["id", "tenant_id"])
    one_row_each(newest, ["id", "tenant_id"], [F.col("text_hash")]).select(
        F.col("id").alias("document_id"),
        "tenant_id",
        "text_hash",
        "seq",
        F.lit(batch_id).cast("bigint").alias("change_batch"),
        "ts",
    ).write.mode("overwrite").json(f"{root}/jobs/batch_id={batch_id}")


def start_ingest(
    requests: DataFrame, root: str, checkpoint: str, max_bytes: int = MAX_TEXT_BYTES, **trigger
) -> StreamingQuery:
    """Run ``ingest_batch`` on a stream. Input offsets commit after it returns."""
    return (
        requests.writeStream.foreachBatch(
            lambda batch, batch_id: ingest_batch(batch, batch_id, root, max_bytes)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
