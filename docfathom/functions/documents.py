"""Scalar expressions over documents, queries and requests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docfathom.functions.vectors import quantized
from docfathom.schemas import DEFAULT_LIMIT, MAX_LIMIT, MAX_TEXT_BYTES


def metadata_to_json(metadata: Column) -> Column:
    """JSON text with sorted keys, so that equal maps give equal text."""
    return F.to_json(sorted_metadata(metadata))


def sorted_metadata(metadata: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.coalesce(metadata, empty_metadata())))
    return F.map_from_entries(entries)


def metadata_from_json(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), empty_metadata())


def empty_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def text_hash(text: Column) -> Column:
    return F.md5(text)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def ingest_reject_reason(
    document_id: Column, text: Column, max_bytes: int = MAX_TEXT_BYTES
) -> Column:
    """NULL where an ingest request is acceptable. Size counts bytes."""
    return (
        F.when(F.coalesce(document_id, F.lit("")) == "", "missing document_id")
        .when(F.coalesce(text, F.lit("")) == "", "text is empty")
        .when(byte_length(text) > max_bytes, "text is too long")
    )


def query_reject_reason(query: Column) -> Column:
    return F.when(F.coalesce(query, F.lit("")) == "", "empty query")


def clamp_limit(limit: Column) -> Column:
    asked = F.coalesce(limit, F.lit(0))
    return (
        F.when(asked <= 0, F.lit(DEFAULT_LIMIT))
        .otherwise(F.least(asked, F.lit(MAX_LIMIT)))
        .cast("int")
    )


def query_fingerprint(tenant_id: Column, model: Column, limit: Column, vector: Column) -> Column:
    """Result key of a query: everything its answer depends on."""
    digest = F.sha2(F.concat_ws("|", model, limit.cast("string"), quantized(vector)), 256)
    return F.concat(F.lit("search:"), tenant_id, F.lit(":"), digest)


def interval(text: str) -> Column:
    """An interval from text such as ``30 minutes``."""
    return F.expr(f"INTERVAL '{text}'")


def older_than(moment: Column, as_of: Column, age: str) -> Column:
    return moment < as_of - interval(age)


def rfc3339(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
