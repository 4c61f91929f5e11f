"""Every query by name, as ``(spark, folder of tables) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docfathom.functions import documents as fn
from docfathom.functions.vectors import cosine_distance, quantized
from docfathom.operators import ann, jobs, lifecycle, monitor, results, similarity
from docfathom.operators.embedding import (
    HashEmbedder,
    PermanentEmbedError,
    embed_documents,
    embed_queries,
    hash_weights,
    search_text_topk,
)
from docfathom.plans import fixtures as fx
from docfathom.schemas import INDEXED
from docfathom.session import bound_batches, materialize, ship_package
from docfathom.sources import messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Backfill age that splits the pending documents of every table size.
AGE = "29 days"
DIMS = 64
CELLS = 32
# The vectors of the tables have few clusters: fewer cells miss over a tenth of the neighbours.
NPROBE = 30
# Cells a pruned search scores before its bounds decide on the rest.
FIRST_CELLS = 4


def named(name: str) -> Callable[[Query], Query]:
    """Register a query whose name is also an imported operator's."""

    def add(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: function(bound_batches(ship_package(spark)), sf_dir)
        return function

    return add


def query(function: Query) -> Query:
    return named(function.__name__)(function)


def moment(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def shown(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(
        "query_id", "rank", "id", F.round("similarity", 6).alias("similarity"), *more
    )


def state(docs: DataFrame) -> DataFrame:
    """Every column of a document table in a form that compares."""
    return docs.select(
        "id",
        "tenant_id",
        fn.text_hash(F.col("text")).alias("text_hash"),
        fn.metadata_to_json(F.col("metadata")).alias("metadata"),
        F.md5(quantized(F.col("embedding"))).alias("embedding_hash"),
        "status",
        "model",
        moment("created_at"),
        moment("updated_at"),
    )


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector of the one-query searches."""
    row = fx.table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding]


# -- sources and messages ---------------------------------------------------


@query
def corpus_scan(spark, sf_dir):
    return state(fx.corpus(spark, sf_dir))


@query
def ingest_parse(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).select("id", "text", "metadata", "status")
    body = F.to_json(F.struct(F.col("id").alias("document_id"), "text", "metadata"))
    # Requests of failed documents were cut short on the way.
    sent = docs.select(
        F.col("id").alias("request_id"),
        F.when(F.col("status") == "failed", F.substring(body, 1, 30)).otherwise(body).alias("body"),
    )
    parsed = messages.parse_ingest_requests(sent, "body")
    return parsed.select(
        "request_id",
        "is_valid",
        F.when(F.col("is_valid"), F.col("document_id")).alias("document_id"),
        F.when(F.col("is_valid"), fn.text_hash(F.col("text"))).alias("text_hash"),
        F.when(F.col("is_valid"), fn.metadata_to_json(F.col("metadata"))).alias("metadata"),
    )


@query
def embed_jobs_emit(spark, sf_dir):
    pending = fx.corpus(spark, sf_dir).filter("status = 'pending'")
    return messages.emit_jobs(
        pending.select(
            F.col("id").alias("document_id"), "tenant_id", fn.text_hash(F.col("text")).alias("text_hash")
        )
    )


def job_messages(spark, sf_dir):
    """A job per event; those of error events were cut to 25 characters."""
    log = fx.events(spark, sf_dir)
    text = messages.job_message(
        (F.col("user_id") * 10).cast("string"),
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")),
    )
    is_cut = F.col("event_type") == "error"
    return log.select("event_id", F.when(is_cut, F.substring(text, 1, 25)).otherwise(text).alias("body"))


@query
def jobs_parse(spark, sf_dir):
    parsed = messages.parse_jobs(job_messages(spark, sf_dir), "body")
    return parsed.select(
        "event_id",
        "is_valid",
        F.when(F.col("is_valid"), F.col("document_id")).alias("document_id"),
        F.when(F.col("is_valid"), F.col("tenant_id")).alias("tenant_id"),
        F.when(~F.col("is_valid"), F.col("body")).alias("dead_letter"),
    )


# -- filters and keyed reads ------------------------------------------------


@query
def validate_documents(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).select("id", "text")
    return lifecycle.validate_documents(docs, max_bytes=8000).select(
        "id", fn.byte_length(F.col("text")).alias("n_bytes"), "reject_reason"
    )


@query
def get_documents(spark, sf_dir):
    found = lifecycle.get_documents(fx.corpus(spark, sf_dir), fx.key_requests(spark, sf_dir))
    return found.select(
        "id",
        "tenant_id",
        "text",
        fn.metadata_to_json(F.col("metadata")).alias("metadata"),
        "status",
        "model",
        moment("created_at"),
        moment("updated_at"),
    )


@query
def jobs_fetch_text(spark, sf_dir):
    return lifecycle.fetch_text(fx.click_jobs(spark, sf_dir), fx.corpus(spark, sf_dir))


@query
def orphan_jobs(spark, sf_dir):
    return lifecycle.orphan_jobs(fx.click_jobs(spark, sf_dir), fx.corpus(spark, sf_dir))


@query
def pending_backfill(spark, sf_dir):
    return lifecycle.pending_backfill(fx.corpus(spark, sf_dir), fx.as_of())


@query
def pending_backfill_tenant(spark, sf_dir):
    return lifecycle.pending_backfill(fx.corpus(spark, sf_dir), fx.as_of(), tenant_id="src3")


@query
def pending_backfill_page(spark, sf_dir):
    return lifecycle.pending_backfill(
        fx.corpus(spark, sf_dir), fx.as_of(), after_id="15", limit=100
    )


def odd_queries(spark, sf_dir):
    """Every conversation turn as a query; turns of assistants lost their text."""
    turns = fx.table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
        F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("query"),
        (F.col("turn") * 40 - 40).alias("limit"),
    )


@query
def validate_queries(spark, sf_dir):
    good, bad = similarity.split_queries(odd_queries(spark, sf_dir))
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad).select(
        "query_id", "reject_reason"
    )


@query
def search_limit_clamp(spark, sf_dir):
    asked = odd_queries(spark, sf_dir)
    return asked.select(
        "query_id", F.col("limit").alias("asked"), fn.clamp_limit(F.col("limit")).alias("given")
    )


# -- similarity -------------------------------------------------------------


@named("cosine_distance")
def cosine_distance_all(spark, sf_dir):
    docs = similarity.searchable(fx.corpus(spark, sf_dir))
    distance = cosine_distance(F.col("embedding"), F.lit(first_vector(spark, sf_dir)))
    return docs.select("id", F.round(distance, 6).alias("distance"))


@query
def search_topk(spark, sf_dir):
    hits = similarity.search_topk(fx.corpus(spark, sf_dir), "src0", first_vector(spark, sf_dir), 10)
    return hits.select(
        "id",
        "text",
        fn.metadata_to_json(F.col("metadata")).alias("metadata"),
        F.round("similarity", 6).alias("similarity"),
    )


@query
def search_topk_batch(spark, sf_dir):
    asked = fx.vector_queries(spark, sf_dir, limit=None)
    return shown(similarity.search_topk_batch(fx.corpus(spark, sf_dir), asked))


@query
def search_topk_blocks(spark, sf_dir):
    """The same with both sides shuffled into blocks, as for very many queries."""
    asked = fx.vector_queries(spark, sf_dir, limit=None)
    return shown(
        similarity.search_topk_batch(fx.corpus(spark, sf_dir), asked, sent_query_bytes=0)
    )


@query
def search_model_guard(spark, sf_dir):
    asked = fx.vector_queries(spark, sf_dir).withColumn("model", F.lit("m1"))
    return shown(similarity.search_same_model(fx.corpus(spark, sf_dir), asked))


@query
def search_model_skipped(spark, sf_dir):
    return similarity.other_model_counts(fx.corpus(spark, sf_dir), "m1")


@query
def tenant_isolation(spark, sf_dir):
    docs, asked = fx.corpus(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    return results.tenant_isolation(asked, similarity.search_topk_batch(docs, asked), docs)


@query
def search_ann(spark, sf_dir):
    docs, asked = fx.corpus(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    return shown(ann.search_pruned(docs, asked, ann.train_cells(docs, CELLS), FIRST_CELLS))


@query
def search_ann_probed(spark, sf_dir):
    """The former search: a fixed number of nearest cells, recall measured, not proven."""
    docs, asked = fx.corpus(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    return shown(ann.search_ann(docs, asked, ann.train_cells(docs, CELLS), NPROBE))


@query
def ann_recall(spark, sf_dir):
    docs, asked = fx.corpus(spark, sf_dir), fx.vector_queries(spark, sf_dir)
    found = ann.search_pruned(docs, asked, ann.train_cells(docs, CELLS), FIRST_CELLS)
    return ann.ann_recall(similarity.search_topk_batch(docs, asked), found)


# -- document writes --------------------------------------------------------


@query
def upsert_documents(spark, sf_dir):
    return state(
        lifecycle.upsert_documents(fx.corpus(spark, sf_dir), fx.upsert_batch(spark, sf_dir))
    )


@query
def upsert_quarantine(spark, sf_dir):
    _, rejected = lifecycle.split_by_owner(
        fx.corpus(spark, sf_dir), fx.upsert_batch(spark, sf_dir)
    )
    return rejected.select("seq", "id", "tenant_id", "reject_reason")


@query
def apply_embeddings(spark, sf_dir):
    return state(
        lifecycle.apply_embeddings(
            fx.corpus(spark, sf_dir), fx.embed_results(spark, sf_dir), fx.as_of()
        )
    )


@query
def mark_failed(spark, sf_dir):
    failures = fx.embed_results(spark, sf_dir).filter("error IS NOT NULL")
    return state(lifecycle.mark_failed(fx.corpus(spark, sf_dir), failures, fx.as_of()))


@query
def embed_outcomes(spark, sf_dir):
    found = lifecycle.embed_outcomes(fx.corpus(spark, sf_dir), fx.embed_results(spark, sf_dir))
    return found.select("id", "outcome", "attempts_total", "error")


@query
def delete_documents(spark, sf_dir):
    return state(
        lifecycle.delete_documents(fx.corpus(spark, sf_dir), fx.key_requests(spark, sf_dir))
    )


@query
def delete_report(spark, sf_dir):
    return lifecycle.delete_report(fx.corpus(spark, sf_dir), fx.key_requests(spark, sf_dir))


@query
def document_lifecycle(spark, sf_dir):
    return state(lifecycle.document_lifecycle(fx.change_log(spark, sf_dir)))


@query
def snapshot_changes(spark, sf_dir):
    """A snapshot brought up to date by a change log."""
    return state(
        lifecycle.apply_changes(fx.corpus(spark, sf_dir), fx.change_log(spark, sf_dir))
    )


@query
def lifecycle_replayed(spark, sf_dir):
    """Every change delivered twice leads to what it leads to once."""
    log = fx.change_log(spark, sf_dir)
    return state(lifecycle.document_lifecycle(log.union(log)))


@query
def snapshot_contested(spark, sf_dir):
    """Ingests and deletes by other tenants leave the documents of a snapshot alone."""
    return state(
        lifecycle.apply_changes(fx.corpus(spark, sf_dir), fx.contested_log(spark, sf_dir))
    )


@query
def snapshot_quarantine(spark, sf_dir):
    refused = lifecycle.refused_changes(fx.corpus(spark, sf_dir), fx.contested_log(spark, sf_dir))
    return refused.select("seq", "id", "tenant_id", "op", "reject_reason")


@query
def reembed_candidates(spark, sf_dir):
    return lifecycle.reembed_candidates(fx.corpus(spark, sf_dir), "m1")


# -- counts and signals -----------------------------------------------------


@query
def count_pending(spark, sf_dir):
    return monitor.count_pending(fx.corpus(spark, sf_dir), fx.as_of(), AGE)


@query
def count_pending_by_tenant(spark, sf_dir):
    return monitor.count_pending_by_tenant(fx.corpus(spark, sf_dir), fx.as_of(), AGE)


@query
def backfill_summary(spark, sf_dir):
    return monitor.backfill_summary(fx.corpus(spark, sf_dir), fx.as_of(), AGE)


@query
def signal_stale_pending(spark, sf_dir):
    return monitor.signal_stale_pending(fx.corpus(spark, sf_dir), fx.as_of())


@query
def signal_latency_p99(spark, sf_dir):
    log = fx.events(spark, sf_dir).withColumnRenamed("value", "duration_ms")
    found = monitor.signal_latency_p99(log, "1 day")
    return found.select(
        moment("window_start"), "n_requests", F.round("p99", 6).alias("p99"), "alert"
    )


@query
def signal_latency_p99_unknown(spark, sf_dir):
    """Requests that failed have no duration."""
    took = F.when(F.col("event_type") != "error", F.col("value"))
    found = monitor.signal_latency_p99(fx.events(spark, sf_dir).withColumn("duration_ms", took), "1 day")
    return found.select(
        moment("window_start"), "n_requests", F.round("p99", 6).alias("p99"), "alert"
    )


@query
def signal_error_rate(spark, sf_dir):
    log = fx.events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    found = monitor.signal_error_rate(log, "1 day")
    return found.select(
        moment("window_start"), "n_calls", "n_errors", F.round("error_rate", 6).alias("error_rate"), "alert"
    )


@query
def signal_backlog(spark, sf_dir):
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1)
    log = fx.events(spark, sf_dir).withColumn("change", change).filter("change IS NOT NULL")
    found = monitor.signal_backlog(log, "1 day", limit=5, buckets=3)
    return found.select(moment("window_start"), "net", "depth", "alert")


@query
def signal_backlog_minutes(spark, sf_dir):
    """Most minutes have no entry, and their depth counts all the same."""
    change = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", -1)
    log = fx.events(spark, sf_dir).withColumn("change", change).filter("change IS NOT NULL")
    found = monitor.signal_backlog(log, "1 minute", limit=5, buckets=5)
    return found.select(moment("window_start"), "net", "depth", "alert")


# -- embedding --------------------------------------------------------------


@query
def hash_embedding(spark, sf_dir):
    return hash_weights(fx.corpus(spark, sf_dir).select("id", "text"), DIMS).select(
        "id", "place", F.round("weight", 6).alias("weight")
    )


@named("embed_documents")
def embed_documents_all(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).select("id", "text")
    return embed_documents(docs, HashEmbedder(DIMS), DIMS, spread=True).select(
        "id", "text_hash", quantized(F.col("embedding")).alias("embedding"), "attempts", "error"
    )


@query
def embed_batches(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).select("id", "text")
    return embed_documents(docs, HashEmbedder(DIMS), DIMS, spread=True).agg(
        F.count("*").alias("n_texts"), (F.max("batch_size") <= 100).alias("within_limit")
    )


@named("search_text_topk")
def search_text_topk_all(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).select("id", "tenant_id", "text")
    vectors = embed_documents(docs, HashEmbedder(DIMS), DIMS, spread=True, keep=["tenant_id"])
    embedded = vectors.filter("error IS NULL").withColumn("status", F.lit(INDEXED))
    return shown(
        search_text_topk(embedded, fx.text_queries(spark, sf_dir), HashEmbedder(DIMS), DIMS)
    )


def picky_embedder(texts):
    """Fails on texts whose length in characters is divisible by three."""
    if any(len(text) % 3 == 0 for text in texts):
        raise PermanentEmbedError("cannot embed")
    return HashEmbedder(DIMS)(texts)


@query
def search_text_rejects(spark, sf_dir):
    """Empty queries and those that cannot be embedded, with the reason."""
    blank = F.when(F.col("query_id").cast("long") % 7 != 0, F.col("query"))
    asked = fx.text_queries(spark, sf_dir).withColumn("query", blank)
    _, rejected = embed_queries(asked, picky_embedder, DIMS)
    return rejected.select("query_id", "tenant_id", "reject_reason")


# -- jobs -------------------------------------------------------------------


@query
def embed_jobs_dedup(spark, sf_dir):
    return jobs.dedup_jobs(fx.click_jobs(spark, sf_dir), window="5 days").select(
        "document_id", moment("ts")
    )


@query
def embed_jobs_dedup_pieces(spark, sf_dir):
    """The same with every document's jobs cut into pieces, as for very many jobs."""
    log = fx.click_jobs(spark, sf_dir)
    return jobs.dedup_jobs(log, window="12 hours", hot_jobs=1).select("document_id", moment("ts"))


@query
def tenant_fifo(spark, sf_dir):
    return jobs.tenant_fifo(fx.click_jobs(spark, sf_dir)).select(
        "tenant_id", "position", "event_id", "document_id"
    )


@query
def expired_jobs(spark, sf_dir):
    old = jobs.expired_jobs(fx.click_jobs(spark, sf_dir), fx.as_of("2024-01-20 00:00:00"))
    return old.select("event_id", "document_id", "tenant_id", moment("ts"))


# -- results ----------------------------------------------------------------


@query
def metadata_roundtrip(spark, sf_dir):
    docs = fx.corpus(spark, sf_dir).select("id", "metadata", "text")
    # Text as a value brings every character that JSON has to escape.
    full = F.map_concat("metadata", F.create_map(F.lit("text"), "text"))
    again = fn.metadata_from_json(fn.metadata_to_json(full))
    return docs.withColumn("again", again).select(
        "id",
        fn.metadata_to_json(F.col("metadata")).alias("plain"),
        F.md5(F.col("again")["text"]).alias("text_hash"),
        F.col("again")["lang"].alias("lang"),
        F.size("again").alias("n_keys"),
    )


@query
def query_fingerprint(spark, sf_dir):
    asked = results.with_cache_key(fx.vector_queries(spark, sf_dir, limit=None), "m1")
    return asked.select("query_id", "tenant_id", "cache_key")


@query
def search_response_json(spark, sf_dir):
    docs, asked = fx.corpus(spark, sf_dir), fx.vector_queries(spark, sf_dir, limit=3)
    return results.search_responses(similarity.search_topk_batch(docs, asked), docs)


@query
def search_result_counts(spark, sf_dir):
    docs, asked = fx.corpus(spark, sf_dir), fx.vector_queries(spark, sf_dir, limit=None)
    return results.search_result_counts(asked, similarity.search_topk_batch(docs, asked))


def cached_results(spark, sf_dir):
    """Results of every query, kept 0 to 270 seconds ago."""
    docs = fx.corpus(spark, sf_dir)
    asked = results.with_cache_key(fx.vector_queries(spark, sf_dir), "m1")
    hits = similarity.search_topk_batch(docs, asked)
    kept_at = fx.as_of() - F.make_dt_interval(secs=F.col("label") * 30)
    # Kept results are a stored table, not a computation.
    return docs, asked, materialize(results.cache_entries(asked, hits, kept_at))


@query
def cached_search(spark, sf_dir):
    docs, asked, cache = cached_results(spark, sf_dir)
    return shown(results.cached_search(docs, asked, cache, fx.as_of()), "from_cache")


@query
def cached_search_merged(spark, sf_dir):
    """Every entry is kept twice, an hour apart; the later one answers, once."""
    docs, asked, cache = cached_results(spark, sf_dir)
    older = cache.withColumn("cached_at", F.col("cached_at") - F.make_dt_interval(hours=F.lit(1)))
    merged = results.put_results(older, cache.union(older))
    return shown(results.cached_search(docs, asked, merged, fx.as_of()), "from_cache")


@query
def invalidate_tenants(spark, sf_dir):
    _, _, cache = cached_results(spark, sf_dir)
    left = results.invalidate_tenants(cache, fx.click_jobs(spark, sf_dir))
    return left.select("cache_key", "tenant_id", F.size("results").alias("n_results"))
