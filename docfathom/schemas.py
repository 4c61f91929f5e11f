"""Schemas and fixed values of the document collection."""

from __future__ import annotations

from pyspark.sql import types as T

# Document states.
PENDING = "pending"
INDEXED = "indexed"
FAILED = "failed"

# Limits, budgets and windows.
DEFAULT_LIMIT = 10
MAX_LIMIT = 100
MAX_TEXT_BYTES = 100_000
EMBED_BATCH_SIZE = 100
EMBED_MAX_ATTEMPTS = 5
EMBED_BASE_DELAY_SECONDS = 1.0
EMBED_JITTER_SECONDS = 0.2
CACHE_TTL_SECONDS = 120
DEDUP_WINDOW = "5 minutes"
JOB_RETENTION = "4 days"
BACKFILL_AGE = "30 minutes"
STALE_PENDING_AGE = "10 minutes"
P99_LIMIT_MS = 200.0
ERROR_RATE_LIMIT = 0.05
BACKLOG_LIMIT = 500
BACKLOG_BUCKETS = 5

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
METADATA = T.MapType(T.StringType(), T.StringType())

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("metadata", METADATA, False),
        T.StructField("embedding", VECTOR, True),
        T.StructField("status", T.StringType(), False),
        T.StructField("model", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

EMBED_JOB = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
    ]
)

INGEST_REQUEST = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)

SEARCH_QUERY = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("query_vec", VECTOR, False),
        T.StructField("limit", T.IntegerType(), True),
    ]
)

# One entry of the append-only change log. ``seq`` is unique and orders it.
CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("metadata", METADATA, True),
        T.StructField("embedding", VECTOR, True),
        T.StructField("model", T.StringType(), True),
        T.StructField("text_hash", T.StringType(), True),
    ]
)

CORRUPT = "_corrupt_record"


def with_corrupt_record(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
