"""JSON messages: ingest requests in, embed jobs in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docfathom.functions.documents import empty_metadata
from docfathom.schemas import CORRUPT, EMBED_JOB, INGEST_REQUEST, with_corrupt_record


def read_messages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = INGEST_REQUEST,
    stream: bool = False,
    max_files: int | None = None,
) -> DataFrame:
    """JSON-lines files. A line that does not parse is kept in ``_corrupt_record``."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.schema(with_corrupt_record(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def parse_messages(rows: DataFrame, body: str, schema: T.StructType) -> DataFrame:
    """Add the fields of a JSON text column, and ``is_valid``."""
    parsed = F.from_json(
        body,
        with_corrupt_record(schema),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    fields = [F.col(f"_parsed.{field.name}").alias(field.name) for field in schema.fields]
    return (
        rows.withColumn("_parsed", parsed)
        .select(
            *rows.columns,
            *fields,
            (F.col(body).isNotNull() & F.col(f"_parsed.{CORRUPT}").isNull()).alias("is_valid"),
        )
    )


def parse_ingest_requests(rows: DataFrame, body: str) -> DataFrame:
    parsed = parse_messages(rows, body, INGEST_REQUEST)
    return parsed.withColumn("metadata", F.coalesce("metadata", empty_metadata()))


def parse_jobs(rows: DataFrame, body: str) -> DataFrame:
    """Jobs and dead letters; rejects keep their text instead of being dropped."""
    return parse_messages(rows, body, EMBED_JOB)


def job_message(document_id: Column, tenant_id: Column) -> Column:
    return F.to_json(F.struct(document_id.alias("document_id"), tenant_id.alias("tenant_id")))


def emit_jobs(jobs: DataFrame) -> DataFrame:
    """Messages with their ordering group and de-duplication id."""
    dedup = (
        F.concat_ws(":", "document_id", "text_hash")
        if "text_hash" in jobs.columns
        else F.col("document_id")
    )
    return jobs.select(
        job_message(F.col("document_id"), F.col("tenant_id")).alias("message"),
        F.col("tenant_id").alias("group_id"),
        dedup.alias("dedup_id"),
    )


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Publish jobs as JSON lines. Writing the same path again replaces it."""
    jobs.write.mode("overwrite").json(path)


def write_jobs_kafka(jobs: DataFrame, servers: str, topic: str) -> None:
    """Publish to a topic, keyed by tenant so a tenant's jobs keep their order.

    Needs Spark's Kafka package on the class path.
    """
    (
        emit_jobs(jobs)
        .select(F.col("group_id").alias("key"), F.col("message").alias("value"))
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )
