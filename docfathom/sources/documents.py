"""Reading and laying out the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docfathom.schemas import DOCUMENTS

TENANT_BUCKETS = 256


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(path)


def read_documents_jdbc(
    spark: SparkSession, url: str, table: str = "documents", parts: int = 64, **options: str
) -> DataFrame:
    """The table as kept in a PostgreSQL database, read in ``parts`` id ranges.

    Metadata arrives as JSON text and vectors as their text form ``[x,y,...]``.
    Needs the database's JDBC driver on the class path.
    """
    ranges = [f"mod(hashtext(id)::bigint + 2147483648, {parts}) = {i}" for i in range(parts)]
    source = (
        f"(SELECT id, tenant_id, text, metadata::text AS metadata, embedding::text AS embedding,"
        f" status, model, created_at, updated_at FROM {table}) AS d"
    )
    rows = spark.read.jdbc(url, source, predicates=ranges, properties=options)
    return rows.withColumns(
        {
            "metadata": F.from_json("metadata", "map<string,string>"),
            "embedding": F.from_json("embedding", "array<float>"),
        }
    )


def tenant_bucket(tenant_id: Column, buckets: int = TENANT_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(tenant_id), F.lit(buckets)).cast("int")


def write_documents(
    docs: DataFrame, path: str, files: int | None = None, buckets: int = TENANT_BUCKETS
) -> None:
    """Write a snapshot that a tenant's search can prune.

    Files are ranges of ``(bucket, tenant, status, id)``: a small tenant sits in
    one file, a tenant with a third of all rows in a third of the files. Within
    a file the order lets row groups of other tenants and states be skipped.
    """
    placed = docs.withColumn("tenant_bucket", tenant_bucket(F.col("tenant_id"), buckets))
    order = ["tenant_bucket", "tenant_id", "status", "id"]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .partitionBy("tenant_bucket")
        .parquet(path)
    )


def tenant_documents(
    spark: SparkSession, path: str, tenant_id: str, buckets: int = TENANT_BUCKETS
) -> DataFrame:
    """One tenant's rows of a written snapshot; other buckets are not listed."""
    rows = spark.read.parquet(path)
    bucket = tenant_bucket(F.lit(tenant_id), buckets)
    return rows.filter((F.col("tenant_bucket") == bucket) & (F.col("tenant_id") == tenant_id)).drop(
        "tenant_bucket"
    )
