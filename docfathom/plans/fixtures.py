"""The engine's inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docfathom.functions.documents import text_hash
from docfathom.schemas import FAILED, INDEXED, PENDING

AS_OF = "2024-02-01 00:00:00"
TENANTS = 20


def as_of(text: str = AS_OF) -> Column:
    return F.to_timestamp(F.lit(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tenant_of(number: str) -> Column:
    return F.concat(F.lit("src"), (F.col(number) % TENANTS).cast("string"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table: one row per document, in every lifecycle state.

    Joined by the id as text, so that joins by ``id`` find its rows in place.
    Whether there is a vector is told apart before the join: those who only need
    status or model do not move vectors.
    """
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    made = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("id"), "event_type", F.col("ts").alias("created_at")
    )
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        "embedding",
        F.col("embedding").isNotNull().alias("is_embedded"),
    )
    is_signup = F.coalesce(F.col("event_type") == "signup", F.lit(False))
    is_embedded = F.coalesce("is_embedded", F.lit(False))
    status = (
        F.when(F.col("event_type") == "error", FAILED)
        .when(is_signup | ~is_embedded, PENDING)
        .otherwise(INDEXED)
    )
    model = F.when(~is_signup & is_embedded, F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2"))
    return (
        docs.join(made, "id", "left")
        .join(vectors, "id", "left")
        .select(
            "id",
            F.col("source").alias("tenant_id"),
            "text",
            F.create_map(
                F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")
            ).alias("metadata"),
            F.when(~is_signup, F.col("embedding")).alias("embedding"),
            status.alias("status"),
            model.alias("model"),
            "created_at",
            F.col("created_at").alias("updated_at"),
        )
    )


def vector_queries(spark: SparkSession, sf_dir: str, limit: int | None = 10) -> DataFrame:
    """Every vector as a query; without a limit, asked limits run from -15 to 120."""
    asked = F.lit(limit) if limit is not None else F.col("label") * 15 - 15
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"),
        tenant_of("vec_id").alias("tenant_id"),
        F.col("embedding").alias("query_vec"),
        asked.cast("int").alias("limit"),
        "label",
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        tenant_of("item_id").alias("tenant_id"),
        F.col("text").alias("query"),
        F.lit(10).alias("limit"),
    )


def click_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embed job log. Some of its documents do not exist."""
    return (
        events(spark, sf_dir)
        .filter(F.col("event_type") == "click")
        .select(
            "event_id",
            (F.col("user_id") * 10).cast("string").alias("document_id"),
            F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
            "ts",
        )
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("owner")
    )


def key_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per event for a document by its owner, or by another tenant."""
    asked = events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 10).cast("string").alias("id"),
        "event_type",
    )
    foreign = F.col("event_type").isin("error", "view") | F.col("owner").isNull()
    return asked.join(owners(spark, sf_dir), "id", "left").select(
        "seq", "id", F.when(foreign, "other").otherwise(F.col("owner")).alias("tenant_id")
    )


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several versions per document, some new ids, some by another tenant."""
    asked = (
        events(spark, sf_dir)
        .filter(F.col("event_type") == "click")
        .select(
            F.col("event_id").alias("seq"),
            (F.col("user_id") * 10).cast("string").alias("id"),
            tenant_of("user_id").alias("home"),
            F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("text"),
            F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"),
            "ts",
        )
    )
    tenant = F.when(F.col("seq") % 10 == 0, "other").otherwise(F.coalesce("owner", "home"))
    return asked.join(owners(spark, sf_dir), "id", "left").select(
        "seq", "ts", "id", tenant.alias("tenant_id"), "text", "metadata"
    )


def embed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding outcome per vector: some failed, some for an older text."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id").cast("string"))
    # Texts are hashed before the join, so that only their hashes move.
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), text_hash(F.col("text")).alias("current_hash")
    )
    failed = F.col("vec_id") % 11 == 0
    return vectors.join(texts, "id").select(
        "id",
        F.when(F.col("vec_id") % 7 == 0, "stale").otherwise(F.col("current_hash")).alias("text_hash"),
        F.when(~failed, F.col("embedding")).alias("embedding"),
        F.lit("m3").alias("model"),
        F.when(failed, "status 500").alias("error"),
        F.col("label").alias("attempts_total"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document changes in event order: ingests, embed outcomes, deletes."""
    return changes_of(made_changes(spark, sf_dir))


def made_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that change a document, and what they do."""
    op = (
        F.when(F.col("event_type").isin("signup", "click"), "ingest")
        .when(F.col("event_type") == "purchase", "embed_ok")
        .when(F.col("event_type") == "error", "embed_fail")
        .when(F.col("value") >= 60, "delete")
    )
    return (
        events(spark, sf_dir)
        .withColumn("op", op)
        .filter("op IS NOT NULL")
        .withColumns({"id": F.col("user_id").cast("string"), "tenant_id": tenant_of("user_id")})
    )


def changes_of(made: DataFrame) -> DataFrame:
    is_ingest, is_ok = F.col("op") == "ingest", F.col("op") == "embed_ok"
    return made.select(
        F.col("event_id").alias("seq"),
        "ts",
        "op",
        "id",
        "tenant_id",
        F.when(is_ingest, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("text"),
        F.when(is_ingest, F.create_map(F.lit("type"), F.col("event_type"))).alias("metadata"),
        F.when(is_ok, F.array(F.col("value").cast("float"))).alias("embedding"),
        F.when(is_ok, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("model"),
        F.lit(None).cast("string").alias("text_hash"),
    )


def contested_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log with every click and delete made by another tenant."""
    # The events are joined as they are; what they contain is made afterwards.
    made = made_changes(spark, sf_dir).join(owners(spark, sf_dir), "id")
    foreign = (F.col("op") == "delete") | ((F.col("op") == "ingest") & (F.col("event_type") == "click"))
    tenant = F.when(foreign, "other").otherwise(F.col("owner"))
    return changes_of(made.withColumn("tenant_id", tenant))
