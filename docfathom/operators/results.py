"""Search results: responses, counts, and a table of results kept for reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docfathom.functions.documents import clamp_limit, query_fingerprint, sorted_metadata
from docfathom.operators.similarity import search_topk_batch
from docfathom.operators.spread import one_row_each
from docfathom.schemas import CACHE_TTL_SECONDS


def with_documents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add text and metadata to ranked hits.

    They are fetched for the hits only, after ranking: scoring never moves text.
    """
    return hits.join(corpus.select("id", "text", "metadata"), "id")


def search_responses(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """One JSON response per query. A query has at most 100 hits."""
    entry = F.struct(
        "rank",
        F.struct(
            F.col("id").alias("document_id"),
            "text",
            sorted_metadata(F.col("metadata")).alias("metadata"),
            F.round("similarity", 6).cast("decimal(9,6)").alias("similarity"),
        ).alias("result"),
    )
    ranked = F.array_sort(F.collect_list(entry), lambda a, b: a["rank"] - b["rank"])
    return (
        with_documents(hits, corpus)
        .groupBy("query_id")
        .agg(F.to_json(F.struct(ranked.getField("result").alias("results"))).alias("response"))
    )


def search_result_counts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Number of results per query, zero included."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.join(counts, "query_id", "left").select(
        "query_id", "tenant_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_results")
    )


def tenant_isolation(queries: DataFrame, hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per asking tenant: results given, and those that are another tenant's (0)."""
    owner = corpus.select("id", F.col("tenant_id").alias("owner"))
    foreign = F.col("owner") != F.col("tenant_id")
    return (
        hits.join(queries.select("query_id", "tenant_id"), "query_id")
        .join(owner, "id")
        .groupBy("tenant_id")
        .agg(F.count("*").alias("n_results"), F.count_if(foreign).alias("n_foreign"))
    )


def with_cache_key(queries: DataFrame, model: str) -> DataFrame:
    key = query_fingerprint(
        F.col("tenant_id"), F.lit(model), clamp_limit(F.col("limit")), F.col("query_vec")
    )
    return queries.withColumn("cache_key", key)


def cache_entries(queries: DataFrame, hits: DataFrame, cached_at: Column) -> DataFrame:
    """One entry per cache key; a query without hits has an empty list.

    ``queries`` carries ``cache_key``; ``cached_at`` may use its columns.
    """
    lists = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "similarity"))).alias("results")
    )
    empty = F.array().cast("array<struct<rank:int,id:string,similarity:double>>")
    entries = queries.join(lists, "query_id", "left").select(
        "cache_key",
        "tenant_id",
        F.coalesce("results", empty).alias("results"),
        cached_at.alias("cached_at"),
    )
    # Equal keys have equal results; only the time can differ.
    return entries.groupBy("cache_key").agg(
        F.any_value("tenant_id").alias("tenant_id"),
        F.any_value("results").alias("results"),
        F.max("cached_at").alias("cached_at"),
    )


def fresh_entries(cache: DataFrame, as_of: Column, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    return cache.filter(F.col("cached_at") > as_of - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def latest_entries(cache: DataFrame) -> DataFrame:
    """One entry per key: the latest, and of equal moments every run takes the same."""
    newest = cache.groupBy("cache_key").agg(F.max("cached_at").alias("cached_at"))
    rows = cache.join(newest, ["cache_key", "cached_at"], "left_semi")
    return one_row_each(rows, ["cache_key"], [F.to_json(F.struct("results"))])


def put_results(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with new entries, each in place of any older one of its key."""
    return latest_entries(cache.unionByName(entries))


def cached_search(
    corpus: DataFrame,
    queries: DataFrame,
    cache: DataFrame,
    as_of: Column,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    **options,
) -> DataFrame:
    """Search, reusing results not older than ``ttl_seconds``.

    Only the queries without such results are searched. Of several entries of one
    key the latest counts.
    """
    fresh = latest_entries(fresh_entries(cache, as_of, ttl_seconds)).select("cache_key", "results")
    hits = (
        queries.select("query_id", "cache_key")
        .join(fresh, "cache_key")
        .select("query_id", F.inline("results"))
        .select("query_id", "rank", "id", "similarity", F.lit(True).alias("from_cache"))
    )
    missed = queries.join(fresh.select("cache_key"), "cache_key", "left_anti")
    searched = search_topk_batch(corpus, missed, **options).withColumn("from_cache", F.lit(False))
    return hits.unionByName(searched)


def invalidate_tenants(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries left after dropping those of tenants whose documents changed."""
    return cache.join(changed.select("tenant_id").distinct(), "tenant_id", "left_anti")
