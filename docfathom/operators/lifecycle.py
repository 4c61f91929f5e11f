"""Document writes as joins: upsert, embed outcome, delete, and the ordered fold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docfathom.functions.documents import (
    empty_metadata,
    ingest_reject_reason,
    older_than,
    text_hash,
)
from docfathom.operators.spread import last_before, lookup_join, one_row_each, sent_if_small
from docfathom.schemas import BACKFILL_AGE, EMBED_MAX_ATTEMPTS, FAILED, INDEXED, MAX_TEXT_BYTES, PENDING
from docfathom.session import materialize

BEFORE_ALL = -(1 << 62)
#: What names a write of a change log.
WRITE = ["id", "seq", "op", "tenant_id"]

STATE = [
    "id",
    "tenant_id",
    "text",
    "metadata",
    "embedding",
    "status",
    "model",
    "created_at",
    "updated_at",
]


def validate_documents(
    requests: DataFrame, document_id: str = "id", max_bytes: int = MAX_TEXT_BYTES
) -> DataFrame:
    reason = ingest_reject_reason(F.col(document_id), F.col("text"), max_bytes)
    return requests.withColumn("reject_reason", reason)


# -- reads by key -----------------------------------------------------------


def get_documents(corpus: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents asked for by ``(id, tenant_id)``; embeddings are not read."""
    asked = sent_if_small(requests.select("id", "tenant_id").distinct())
    return corpus.drop("embedding").join(asked, ["id", "tenant_id"], "left_semi")


def fetch_text(jobs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Text of every document that has jobs, with its number of jobs.

    Jobs are counted per document before the join, so a document with very many
    of them is one row there.
    """
    asked = jobs.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_jobs"))
    return corpus.select("id", "text").join(sent_if_small(asked), "id")


def orphan_jobs(jobs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Jobs whose document is gone, counted per document."""
    asked = jobs.groupBy("document_id").agg(F.count("*").alias("n_jobs"))
    return asked.join(_present(corpus, asked, "document_id"), "document_id", "left_anti")


def _present(corpus: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """Those of the asked ids that the corpus has. Few are sent to where it lies."""
    ids = sent_if_small(asked.select(F.col(name).alias("id")).distinct())
    return corpus.select("id").join(ids, "id", "left_semi").withColumnRenamed("id", name)


# -- upsert -----------------------------------------------------------------


def _claims(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per (id, tenant) of a batch, and whether that tenant owns the id.

    An id belongs to the tenant that holds it in the snapshot, else to the first
    tenant that writes it in the batch.
    """
    claims = batch.groupBy("id", "tenant_id").agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.min_by("ts", "seq").alias("first_at"),
    )
    named = sent_if_small(claims.select("id").distinct())
    held = snapshot.select("id", F.col("tenant_id").alias("held_by")).join(named, "id", "left_semi")
    # Sorts the tenants that write one id, not their writes.
    among = Window.partitionBy("id").orderBy("first_seq")
    first_claim = F.row_number().over(among) == 1
    return claims.withColumn("is_first", first_claim).join(held, "id", "left").select(
        "id",
        "tenant_id",
        "last_seq",
        "first_at",
        F.col("held_by").isNotNull().alias("is_held"),
        F.coalesce(F.col("held_by") == F.col("tenant_id"), F.col("is_first")).alias("owned"),
    )


def split_by_owner(snapshot: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch their tenant may write, and the quarantined others."""
    verdict = _claims(snapshot, batch).select("id", "tenant_id", "owned")
    judged = lookup_join(batch, verdict, ["id", "tenant_id"], F.col("seq"))
    return (
        judged.filter("owned").drop("owned"),
        judged.filter("NOT owned")
        .drop("owned")
        .withColumn("reject_reason", F.lit("tenant_mismatch")),
    )


def upsert_documents(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot after a batch ``(seq, ts, id, tenant_id, text, metadata)``.

    The last accepted version of an id wins. Creation time is that of the first,
    tenant and model stay those of an existing row, and the vector is dropped.
    """
    owned = _claims(snapshot, batch).filter("owned").drop("owned")
    versions = batch.select(
        "id",
        F.col("seq").alias("last_seq"),
        F.col("text").alias("new_text"),
        F.coalesce("metadata", empty_metadata()).alias("new_metadata"),
        F.col("ts").alias("written_at"),
    )
    written = owned.withColumnRenamed("tenant_id", "new_tenant").join(
        versions, ["id", "last_seq"]
    )
    # Unlike a full outer join, a left join lets a small batch be broadcast and
    # the snapshot stay where it is.
    hit = F.col("written_at").isNotNull()
    width = [F.octet_length(F.col(c)) for c in ("id", "new_tenant", "new_text")]
    changed = sent_if_small(
        written.filter("is_held"), *width, F.octet_length(F.to_json("new_metadata"))
    )
    rewritten = snapshot.join(changed, "id", "left").select(
        "id",
        "tenant_id",
        F.when(hit, F.col("new_text")).otherwise(F.col("text")).alias("text"),
        F.when(hit, F.col("new_metadata")).otherwise(F.col("metadata")).alias("metadata"),
        F.when(~hit, F.col("embedding")).alias("embedding"),
        F.when(hit, PENDING).otherwise(F.col("status")).alias("status"),
        "model",
        "created_at",
        F.coalesce("written_at", "updated_at").alias("updated_at"),
    )
    added = written.filter("NOT is_held").select(
        "id",
        F.col("new_tenant").alias("tenant_id"),
        F.col("new_text").alias("text"),
        F.col("new_metadata").alias("metadata"),
        F.lit(None).cast(snapshot.schema["embedding"].dataType).alias("embedding"),
        F.lit(PENDING).alias("status"),
        F.lit(None).cast("string").alias("model"),
        F.col("first_at").alias("created_at"),
        F.col("written_at").alias("updated_at"),
    )
    return rewritten.unionByName(added)


# -- embed outcomes ---------------------------------------------------------


def embed_outcomes(
    corpus: DataFrame, results: DataFrame, budget: int = EMBED_MAX_ATTEMPTS
) -> DataFrame:
    """What each result ``(id, text_hash, error, attempts_total)`` leads to."""
    asked = sent_if_small(results.select("id").distinct())
    current = corpus.select("id", "text").join(asked, "id", "left_semi")
    current = current.select("id", text_hash(F.col("text")).alias("current_hash"))
    return (
        results.join(current, "id", "left")
        .withColumn("outcome", _outcome(budget))
        .drop("current_hash")
    )


def _outcome(budget: int) -> Column:
    return (
        F.when(F.col("current_hash").isNull(), "discarded")
        .when(~F.col("text_hash").eqNullSafe(F.col("current_hash")), "stale")
        .when(F.col("error").isNull(), INDEXED)
        .when(F.col("attempts_total") >= budget, FAILED)
        .otherwise("retry")
    )


def apply_embeddings(corpus: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Store vectors made from the text a document still has, and mark it indexed.

    A result for an older text, or for a document that is gone, changes nothing. Of
    several results for one text every run takes the same one.
    """
    stored = results.filter(F.col("error").isNull() & F.col("embedding").isNotNull())
    good = one_row_each(stored, ["id", "text_hash"], [F.col("model"), F.col("embedding")]).select(
        F.col("id").alias("made_for"),
        F.col("text_hash").alias("made_from"),
        F.col("embedding").alias("new_embedding"),
        F.col("model").alias("new_model"),
    )
    # Counted without the vectors: only few rows are looked at for their size.
    good = sent_if_small(good, F.size("new_embedding") * 4, counted=stored.select("id", "text_hash").distinct())
    current = corpus.withColumn("text_hash", text_hash(F.col("text")))
    # Documents that lie by id stay where they are, as a join by the hash too would not let
    # them; an equality inside COALESCE is no key of the join. At most one result fits.
    fits = F.coalesce(F.col("text_hash") == F.col("made_from"), F.lit(False))
    joined = current.join(good, (F.col("id") == F.col("made_for")) & fits, "left")
    hit = F.col("new_embedding").isNotNull()
    return joined.select(
        "id",
        "tenant_id",
        "text",
        "metadata",
        F.coalesce("new_embedding", "embedding").alias("embedding"),
        F.when(hit, INDEXED).otherwise(F.col("status")).alias("status"),
        F.coalesce("new_model", "model").alias("model"),
        "created_at",
        F.when(hit, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def mark_failed(corpus: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """Mark documents failed; vector and model stay as they are."""
    failed = sent_if_small(failures.select("id").distinct().withColumn("hit", F.lit(True)))
    hit = F.col("hit").isNotNull()
    return (
        corpus.join(failed, "id", "left")
        .withColumn("status", F.when(hit, FAILED).otherwise(F.col("status")))
        .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
        .select(*STATE)
    )


# -- delete -----------------------------------------------------------------


def delete_documents(corpus: DataFrame, requests: DataFrame) -> DataFrame:
    asked = sent_if_small(requests.select("id", "tenant_id").distinct())
    return corpus.join(asked, ["id", "tenant_id"], "left_anti")


def delete_report(corpus: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request ``(seq, id, tenant_id)`` with whether it removed a row.

    Of several matching requests the first one does.
    """
    first = requests.groupBy("id", "tenant_id").agg(F.min("seq").alias("seq"))
    first = (
        corpus.select("id", "tenant_id")
        .join(sent_if_small(first), ["id", "tenant_id"])
        .withColumn("deleted", F.lit(True))
    )
    # ``seq`` in the key spreads the requests of one much-deleted id.
    return requests.join(first, ["id", "tenant_id", "seq"], "left").withColumn(
        "deleted", F.coalesce("deleted", F.lit(False))
    )


# -- the ordered fold -------------------------------------------------------


def split_contested(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes a tenant may make, and the quarantined others.

    An id belongs to the tenant of its first ingest until that tenant deletes
    it. Of writes at the same ``seq`` that of the smaller tenant comes first. Only
    ids written by more than one tenant need their changes walked in order; the
    walk streams over sorted rows and keeps one owner at a time.
    """
    rejected = _contested_writes(changes)
    return (
        changes.join(rejected, WRITE, "left_anti"),
        changes.join(rejected, WRITE, "left_semi").withColumn(
            "reject_reason", F.lit("tenant_mismatch")
        ),
    )


def _contested_writes(changes: DataFrame) -> DataFrame:
    """The writes (``WRITE``) that ``split_contested`` sets aside."""
    writes = changes.filter(F.col("op").isin("ingest", "delete")).select(
        "id", "seq", "op", "tenant_id"
    )
    tenant = F.xxhash64("tenant_id")
    contested = writes.groupBy("id").agg(F.min(tenant).alias("a"), F.max(tenant).alias("b"))
    contested = contested.filter("a <> b").select("id")
    return (
        writes.join(contested, "id", "left_semi")
        # By an expression: Spark 4.1 drops a repartitioning by the column itself above
        # a union that seems to have it, and may then read that union's parts locally.
        .repartition(F.xxhash64("id"))
        .sortWithinPartitions("id", "seq", "tenant_id", "op")
        .mapInArrow(_rejected_writes, "id string, seq bigint, op string, tenant_id string")
    )


def _rejected_writes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refused writes, each once: writes that came twice lie side by side."""
    current, owner, told = None, None, None
    for batch in batches:
        refused = []
        for row, write in enumerate(zip(*(column.to_pylist() for column in batch.columns))):
            id_, _, op, tenant = write
            if id_ != current:
                current, owner = id_, None
            if op == "ingest" and owner is None:
                owner = tenant
            elif owner is not None and tenant != owner:
                if write != told:
                    refused.append(row)
                    told = write
            elif op == "delete":
                owner = None
        yield batch.take(pa.array(refused, pa.int64()))


def document_lifecycle(changes: DataFrame) -> DataFrame:
    """The live documents after a change log (schema ``CHANGE``).

    Within an id, changes apply in the order of ``seq``: ``ingest`` inserts or
    resets, ``embed_ok`` and ``embed_fail`` act on an existing document (and
    ``embed_ok`` only while its ``text_hash``, if given, fits the text),
    ``delete`` removes. One tenant writes an id; see ``split_contested``.

    A change may be delivered more than once: rows of equal id, ``seq`` and ``op``
    count as one. The fold is taken apart into maxima and minima of ``seq``, which
    combine before they are shuffled; payloads are then fetched by ``seq``.
    """
    return _folded(changes)


def _folded(changes: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """``document_lifecycle`` of the changes without the ``rejected`` writes.

    Those are taken out of what each step has kept of the changes. So no text or
    vector is shuffled to find out that its write counts.
    """

    def accepted(rows: DataFrame) -> DataFrame:
        return rows if rejected is None else rows.join(rejected, WRITE, "left_anti")

    removed = (
        accepted(changes.filter(F.col("op") == "delete").select(*WRITE))
        .groupBy("id")
        .agg(F.max("seq").alias("removed_seq"))
    )
    # A text is known by its hash, so the fold itself does not carry texts.
    made_from = F.when(F.col("op") == "ingest", F.coalesce(F.md5("text"), F.lit(""))).otherwise(
        F.col("text_hash")
    )
    slim = changes.select(*WRITE, "ts", made_from.alias("text_hash"))
    # Only writes are rejected.
    slim = (
        accepted(slim.filter(F.col("op") == "ingest"))
        .unionByName(slim.filter(~F.col("op").isin("ingest", "delete")))
        .groupBy("id", "seq", "op", "text_hash")
        .agg(F.min("ts").alias("ts"))
    )
    since = lookup_join(slim, removed, ["id"], F.col("seq"), "left").filter(
        F.col("seq") > F.coalesce("removed_seq", F.lit(BEFORE_ALL))
    )
    since = materialize(since.drop("removed_seq"))

    def last(op: str) -> Column:
        return F.max(F.when(F.col("op") == op, F.col("seq")))

    def last_at(op: str) -> Column:
        return F.max_by("ts", F.when(F.col("op") == op, F.col("seq")))

    ingest = F.when(F.col("op") == "ingest", F.col("seq"))
    by_text = since.groupBy("id", "text_hash").agg(
        F.min(ingest).alias("first_seq"),
        F.min_by("ts", ingest).alias("created_at"),
        last("ingest").alias("ingest_seq"),
        last_at("ingest").alias("ingested_at"),
        last("embed_fail").alias("fail_seq"),
        last_at("embed_fail").alias("failed_at"),
        last("embed_ok").alias("ok_seq"),
        last_at("embed_ok").alias("ok_at"),
    )
    newest = F.when(F.col("ingest_seq").isNotNull(), F.struct("ingest_seq", "text_hash"))
    live = (
        by_text.groupBy("id")
        .agg(
            F.min("first_seq").alias("first_seq"),
            F.min_by("created_at", "first_seq").alias("created_at"),
            F.max("ingest_seq").alias("ingest_seq"),
            F.max_by("ingested_at", "ingest_seq").alias("ingested_at"),
            F.max("fail_seq").alias("fail_seq"),
            F.max_by("failed_at", "fail_seq").alias("failed_at"),
            F.max(newest)["text_hash"].alias("current_hash"),
        )
        .filter("ingest_seq IS NOT NULL")
        .join(_fitting_outcomes(since), "id", "left")
    )

    # The last vector that counts: made after the last ingest, from its text.
    outcomes = by_text.filter("ok_seq IS NOT NULL").select("id", "text_hash", "ok_seq", "ok_at")
    matching = (
        live.select("id", "ingest_seq", "current_hash")
        .join(outcomes, "id")
        .filter(F.coalesce("text_hash", "current_hash") == F.col("current_hash"))
        .filter("ok_seq > ingest_seq")
        .groupBy("id")
        .agg(F.max("ok_seq").alias("ok_seq"), F.max_by("ok_at", "ok_seq").alias("ok_at"))
    )
    # ``model`` outlives a re-ingest: without such a vector it is that of the
    # last one since creation that was made from the text of its time.
    earlier_ok = F.when(F.col("fitting_seq") > F.col("first_seq"), F.col("fitting_seq"))
    live = materialize(
        live.join(matching, "id", "left").withColumn("made_seq", F.coalesce(F.col("ok_seq"), earlier_ok))
    )
    contents = changes.filter(F.col("op") == "ingest").select(
        "id",
        F.col("seq").alias("ingest_seq"),
        F.coalesce(F.md5("text"), F.lit("")).alias("current_hash"),
        "tenant_id",
        "text",
        "metadata",
    )
    written = ["id", "ingest_seq", "current_hash"]
    contents = live.join(contents, written)
    if rejected is not None:
        # By another tenant at the very ``seq`` of a document's last ingest: hardly any.
        last_writes = live.select("id", F.col("ingest_seq").alias("seq"))
        others = rejected.filter(F.col("op") == "ingest").join(last_writes, ["id", "seq"], "left_semi")
        others = others.select("id", F.col("seq").alias("ingest_seq"), "tenant_id")
        contents = contents.join(sent_if_small(others), ["id", "ingest_seq", "tenant_id"], "left_anti")
    live = one_row_each(contents, written, [F.col("tenant_id"), F.to_json("metadata")])
    vectors = changes.filter(F.col("op") == "embed_ok").select(
        "id", F.col("seq").alias("made_seq"), "model", "embedding"
    )
    live = one_row_each(
        live.join(vectors, ["id", "made_seq"], "left"),
        ["id", "made_seq"],
        [F.col("model"), F.col("embedding")],
    )
    # GREATEST passes over NULL; outcomes older than the last ingest decide nothing.
    is_failed = F.col("fail_seq") > F.greatest("ingest_seq", "ok_seq")
    has_vector = F.col("ok_seq").isNotNull()
    return live.select(
        "id",
        "tenant_id",
        "text",
        F.coalesce("metadata", empty_metadata()).alias("metadata"),
        F.when(has_vector, F.col("embedding")).alias("embedding"),
        F.when(is_failed, FAILED).when(has_vector, INDEXED).otherwise(PENDING).alias("status"),
        "model",
        "created_at",
        F.when(is_failed, F.col("failed_at"))
        .otherwise(F.coalesce("ok_at", "ingested_at"))
        .alias("updated_at"),
    )


def _fitting_outcomes(since: DataFrame) -> DataFrame:
    """(id, fitting_seq): the last vector made from the text its document had then.

    A vector that names no text fits. Only documents with one that does need to
    know which text was there.
    """
    is_ok = F.col("op") == "embed_ok"
    named = since.filter(is_ok & F.col("text_hash").isNotNull()).select("id").distinct()
    rows = since.join(named, "id", "left_semi").withColumn(
        "written", F.when(F.col("op") == "ingest", F.col("text_hash"))
    )
    told = last_before(rows, "id", "seq", "written", "there", BEFORE_ALL + 9)
    fits = told.filter(is_ok & F.coalesce(F.col("text_hash") == F.col("there"), F.col("text_hash").isNull()))
    plain = since.filter(is_ok).join(named, "id", "left_anti")
    return fits.select("id", "seq").union(plain.select("id", "seq")).groupBy("id").agg(
        F.max("seq").alias("fitting_seq")
    )


def _one_log(snapshot: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that no change names, and the start of a log that leads to the others.

    Those are the few changes that make a document of the snapshot, numbered below
    any real ``seq``. So the log also says who owns the id.
    """
    named = sent_if_small(changes.select("id").distinct())
    kept = snapshot.join(named, "id", "left_anti").select(*STATE)
    base = snapshot.join(named, "id", "left_semi")
    steps = F.filter(
        F.array(
            _step(1, "ingest", "created_at"),
            F.when(F.col("model").isNotNull(), _step(2, "embed_ok", "updated_at")),
            F.when(F.col("status") == PENDING, _step(3, "ingest", "updated_at")),
            F.when(F.col("status") == FAILED, _step(4, "embed_fail", "updated_at")),
        ),
        lambda step: step.isNotNull(),
    )
    # A vector is repeated only where it is stored, on its own step.
    is_vector = F.col("step.op") == "embed_ok"
    earlier = base.withColumn("step", F.explode(steps)).select(
        F.col("step.seq").alias("seq"),
        F.col("step.ts").alias("ts"),
        F.col("step.op").alias("op"),
        "id",
        "tenant_id",
        F.when(F.col("step.op") == "ingest", F.col("text")).alias("text"),
        F.when(F.col("step.op") == "ingest", F.col("metadata")).alias("metadata"),
        F.when(is_vector, F.col("embedding")).alias("embedding"),
        F.when(is_vector, F.col("model")).alias("model"),
        F.lit(None).cast("string").alias("text_hash"),
    )
    return kept, earlier


def apply_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The live documents after ``changes`` to a snapshot, both folded as one log.

    Documents no change names pass through. A change by another tenant than the
    one that has the document, in the snapshot or since, has no effect.
    """
    kept, earlier = _one_log(snapshot, changes)
    # Written once: a snapshot may be a join of whole tables, and the log is read often.
    log = materialize(earlier).unionByName(changes.select(*earlier.columns))
    return kept.unionByName(_folded(log, materialize(_contested_writes(log))))


def refused_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes that ``apply_changes`` sets aside, with their reason."""
    _, earlier = _one_log(snapshot, changes)
    return split_contested(earlier.unionByName(changes.select(*earlier.columns)))[1]


def _step(number: int, op: str, moment: str) -> Column:
    return F.struct(
        F.lit(BEFORE_ALL + number).alias("seq"), F.lit(op).alias("op"), F.col(moment).alias("ts")
    )


# -- work still to do -------------------------------------------------------


def pending_documents(
    corpus: DataFrame, as_of: Column, age: str = BACKFILL_AGE, age_column: str = "created_at"
) -> DataFrame:
    return corpus.filter(
        (F.col("status") == PENDING) & older_than(F.col(age_column), as_of, age)
    )


def pending_backfill(
    corpus: DataFrame,
    as_of: Column,
    age: str = BACKFILL_AGE,
    tenant_id: str = "",
    after_id: str = "",
    limit: int | None = None,
    age_column: str = "created_at",
) -> DataFrame:
    """Jobs for documents pending too long. Not written anywhere: that is the dry run.

    One scan needs no pages; ``after_id`` and ``limit`` serve runs that resume.
    """
    rows = pending_documents(corpus, as_of, age, age_column)
    if tenant_id:
        rows = rows.filter(F.col("tenant_id") == tenant_id)
    if after_id:
        rows = rows.filter(F.col("id") > after_id)
    jobs = rows.select(F.col("id").alias("document_id"), "tenant_id")
    return jobs if limit is None else jobs.orderBy("document_id").limit(limit)


def reembed_candidates(corpus: DataFrame, model: str) -> DataFrame:
    """Jobs for documents whose vector is another model's."""
    return corpus.filter(F.col("model") != model).select(
        F.col("id").alias("document_id"), "tenant_id", F.col("model").alias("old_model")
    )
