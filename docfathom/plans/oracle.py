"""The same queries as SQL over the same tables, for checking results."""

from __future__ import annotations

CORPUS = """
corpus AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source AS tenant_id, d.text, d.lang, d.source,
         MAP {'lang': d.lang, 'source': d.source} AS metadata,
         CASE WHEN e.event_type IS DISTINCT FROM 'signup' THEN v.embedding END AS embedding,
         CASE WHEN e.event_type = 'error' THEN 'failed'
              WHEN e.event_type = 'signup' OR v.embedding IS NULL THEN 'pending'
              ELSE 'indexed' END AS status,
         CASE WHEN e.event_type IS DISTINCT FROM 'signup' AND v.embedding IS NOT NULL
              THEN CASE WHEN d.doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END END AS model,
         e.ts AS created_at, e.ts AS updated_at
  FROM documents d
  LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN embeddings v ON v.vec_id = d.doc_id)
"""


def quantized(vector: str) -> str:
    return (
        "array_to_string([CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) "
        f"for x in {vector}], ',')"
    )


def moment(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


STATE = f"""
id, tenant_id, md5(text) AS text_hash, CAST(to_json(metadata) AS VARCHAR) AS metadata,
md5({quantized("embedding")}) AS embedding_hash, status, model,
{moment("created_at")}, {moment("updated_at")}
"""

LABEL_LIMIT = "label * 15 - 15"


def vector_queries(limit: str = "10") -> str:
    return f"""
queries AS (
  SELECT CAST(vec_id AS VARCHAR) AS query_id, 'src' || (vec_id % 20) AS tenant_id,
         CAST(embedding AS DOUBLE[]) AS query_vec, embedding AS raw_vec, label,
         CASE WHEN ({limit}) <= 0 THEN 10 ELSE least({limit}, 100) END AS k
  FROM embeddings)
"""


def ranked(extra: str = "") -> str:
    return f"""
scored AS (
  SELECT q.query_id, q.k, q.tenant_id AS asked_by, q.label, c.id, c.tenant_id AS owner,
         c.text, c.metadata,
         list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), q.query_vec) AS similarity
  FROM queries q JOIN corpus c ON c.tenant_id = q.tenant_id
  WHERE c.status = 'indexed' {extra}),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(similarity, 12) DESC NULLS LAST, id) AS rank FROM scored),
hits AS (SELECT * FROM ordered WHERE rank <= k)
"""


HITS = "SELECT query_id, rank, id, round(similarity, 6) AS similarity FROM hits"

CLICKS = """
clicks AS (
  SELECT event_id, CAST(user_id * 10 AS VARCHAR) AS document_id,
         'src' || (user_id % 5) AS tenant_id, ts
  FROM events WHERE event_type = 'click')
"""

REQUESTS = """
requests AS (
  SELECT e.event_id AS seq, CAST(e.user_id * 10 AS VARCHAR) AS id,
         CASE WHEN e.event_type IN ('error', 'view') OR d.source IS NULL THEN 'other'
              ELSE d.source END AS tenant_id
  FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id * 10)
"""

BATCH = """
batch AS (
  SELECT e.event_id AS seq, e.ts, CAST(e.user_id * 10 AS VARCHAR) AS id,
         CASE WHEN e.event_id % 10 = 0 THEN 'other'
              ELSE coalesce(d.source, 'src' || (e.user_id % 20)) END AS tenant_id,
         'v' || e.event_id AS text,
         MAP {'k': CAST(json_extract(e.props, '$.k') AS VARCHAR)} AS metadata
  FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id * 10
  WHERE e.event_type = 'click'),
judged AS (
  SELECT b.*, b.tenant_id = coalesce(c.tenant_id,
           first_value(b.tenant_id) OVER (PARTITION BY b.id ORDER BY b.seq)) AS accepted
  FROM batch b LEFT JOIN corpus c ON c.id = b.id)
"""

RESULTS = """
results AS (
  SELECT CAST(v.vec_id AS VARCHAR) AS id,
         CASE WHEN v.vec_id % 7 = 0 THEN 'stale' ELSE md5(d.text) END AS text_hash,
         CASE WHEN v.vec_id % 11 <> 0 THEN v.embedding END AS embedding,
         CASE WHEN v.vec_id % 11 = 0 THEN 'status 500' END AS error,
         v.label AS attempts_total
  FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id)
"""

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"

MESSAGES = """
sent AS (
  SELECT event_id, event_type = 'error' AS is_cut,
         CAST(user_id * 10 AS VARCHAR) AS document_id, 'src' || (user_id % 5) AS tenant_id
  FROM events),
messages AS (
  SELECT *, CASE WHEN is_cut THEN substr(full_body, 1, 25) ELSE full_body END AS body
  FROM (SELECT *, '{"document_id":"' || document_id || '","tenant_id":"' || tenant_id || '"}'
          AS full_body FROM sent))
"""


def pending(age: str) -> str:
    return f"status = 'pending' AND created_at < {AS_OF} - INTERVAL '{age}'"


CHANGES = """
changes AS (
  SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS id, user_id, event_type, value,
         CASE WHEN event_type IN ('signup', 'click') THEN 'ingest'
              WHEN event_type = 'purchase' THEN 'embed_ok'
              WHEN event_type = 'error' THEN 'embed_fail'
              WHEN value >= 60 THEN 'delete' END AS op
  FROM events),
since AS (
  SELECT * FROM (
    SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY id) AS removed
    FROM changes WHERE op IS NOT NULL)
  WHERE seq > coalesce(removed, -1)),
bounds AS (
  SELECT *, min(CASE WHEN op = 'ingest' THEN seq END) OVER (PARTITION BY id) AS first_seq,
         max(CASE WHEN op = 'ingest' THEN seq END) OVER (PARTITION BY id) AS last_seq
  FROM since),
folded AS (
  SELECT id, any_value(user_id) AS user_id, any_value(last_seq) AS last_seq,
         arg_max(event_type, seq) FILTER (op = 'ingest') AS kind,
         arg_min(ts, seq) FILTER (op = 'ingest') AS created_at,
         arg_max(ts, seq) AS updated_at,
         arg_max(value, seq) FILTER (op = 'embed_ok' AND seq > last_seq) AS vector_value,
         arg_max(seq, seq) FILTER (op = 'embed_ok') AS model_seq,
         coalesce(arg_max(op, seq) FILTER (seq > last_seq), 'none') AS last_op
  FROM bounds WHERE seq >= first_seq GROUP BY id)
"""

# Without what other tenants try.
OWN_CHANGES = CHANGES.replace("event_type IN ('signup', 'click')", "event_type = 'signup'").replace(
    "WHEN value >= 60 THEN 'delete' END", "END"
)

MERGED = """
log AS (
  SELECT seq, ts, op, id, 'src' || (user_id % 20) AS tenant_id, 'v' || seq AS text,
         MAP {'type': event_type} AS metadata, [CAST(value AS FLOAT)] AS embedding,
         'm' || (seq % 3) AS model
  FROM changes WHERE op IS NOT NULL
  UNION ALL
  SELECT s.seq, CASE WHEN s.seq = -4 THEN created_at ELSE updated_at END, s.op, id, tenant_id,
         text, metadata, embedding, model
  FROM corpus JOIN (VALUES (-4, 'ingest'), (-3, 'embed_ok'), (-2, 'ingest'), (-1, 'embed_fail'))
    AS s(seq, op) ON s.seq = -4 OR (s.seq = -3 AND model IS NOT NULL)
      OR (s.seq = -2 AND status = 'pending') OR (s.seq = -1 AND status = 'failed')
  WHERE id IN (SELECT id FROM changes WHERE op IS NOT NULL)),
alive AS (
  SELECT *, min(CASE WHEN op = 'ingest' THEN seq END) OVER (PARTITION BY id) AS first_seq,
         max(CASE WHEN op = 'ingest' THEN seq END) OVER (PARTITION BY id) AS last_seq
  FROM (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY id) AS removed
        FROM log)
  WHERE seq > coalesce(removed, -9)),
merged AS (
  SELECT id, any_value(tenant_id) AS tenant_id,
         arg_max(text, seq) FILTER (op = 'ingest') AS text,
         arg_max(metadata, seq) FILTER (op = 'ingest') AS metadata,
         arg_max(embedding, seq) FILTER (op = 'embed_ok' AND seq > last_seq) AS embedding,
         CASE coalesce(arg_max(op, seq) FILTER (seq > last_seq), 'none') WHEN 'none' THEN 'pending'
           WHEN 'embed_ok' THEN 'indexed' ELSE 'failed' END AS status,
         arg_max(model, seq) FILTER (op = 'embed_ok') AS model,
         arg_min(ts, seq) FILTER (op = 'ingest') AS created_at, arg_max(ts, seq) AS updated_at
  FROM alive WHERE seq >= first_seq GROUP BY id
  UNION ALL
  SELECT id, tenant_id, text, metadata, embedding, status, model, created_at, updated_at
  FROM corpus WHERE id NOT IN (SELECT id FROM changes WHERE op IS NOT NULL))
"""

WORDS = """
texts AS ({texts}),
words AS (
  SELECT id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS word FROM texts),
counts AS (
  SELECT id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS place, count(*) AS n
  FROM words WHERE word <> '' GROUP BY ALL),
lengths AS (SELECT id, sqrt(sum(n * n)) AS length FROM counts GROUP BY id),
vectors AS (
  SELECT t.id, list(CAST(CAST(coalesce(c.n / l.length, 0) AS FLOAT) AS DOUBLE)
           ORDER BY p.place) AS vector
  FROM texts t CROSS JOIN (SELECT unnest(range(64)) AS place) p
  LEFT JOIN counts c ON c.id = t.id AND c.place = p.place
  LEFT JOIN lengths l ON l.id = t.id GROUP BY t.id)
"""


def words(texts: str) -> str:
    return WORDS.replace("{texts}", texts)


DOC_TEXTS = "SELECT 'd' || doc_id AS id, text FROM documents"

FINGERPRINT = f"""'search:' || tenant_id || ':' ||
  sha256('m1|' || k || '|' || {quantized("raw_vec")})"""

TURNS = """
turns AS (
  SELECT conv_id || '-' || turn AS query_id,
         CASE WHEN role = 'user' THEN text ELSE '' END AS query, turn * 40 - 40 AS asked
  FROM conversations)
"""


def given(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def dedup(window: str) -> str:
    return f"""WITH RECURSIVE jobs AS (
           SELECT DISTINCT CAST(user_id * 10 AS VARCHAR) AS document_id, ts
           FROM events WHERE event_type = 'click'),
         accepted AS (
           SELECT document_id, min(ts) AS ts FROM jobs GROUP BY document_id
           UNION ALL
           SELECT a.document_id, min(j.ts) AS ts FROM accepted a
           JOIN jobs j ON j.document_id = a.document_id AND j.ts >= a.ts + INTERVAL '{window}'
           GROUP BY a.document_id)
         SELECT document_id, {moment("ts")} FROM accepted"""


ORACLE: dict[str, str] = {
    "corpus_scan": given(CORPUS) + f"SELECT {STATE} FROM corpus",
    "ingest_parse": given(CORPUS)
    + """SELECT id AS request_id, status <> 'failed' AS is_valid,
           CASE WHEN status <> 'failed' THEN id END AS document_id,
           CASE WHEN status <> 'failed' THEN md5(text) END AS text_hash,
           CASE WHEN status <> 'failed' THEN CAST(to_json(metadata) AS VARCHAR) END AS metadata
         FROM corpus""",
    "embed_jobs_emit": given(CORPUS)
    + """SELECT '{"document_id":"' || id || '","tenant_id":"' || tenant_id || '"}' AS message,
           tenant_id AS group_id, id || ':' || md5(text) AS dedup_id
         FROM corpus WHERE status = 'pending'""",
    "jobs_parse": given(MESSAGES)
    + """SELECT event_id, json_valid(body) AS is_valid,
           CASE WHEN json_valid(body) THEN document_id END AS document_id,
           CASE WHEN json_valid(body) THEN tenant_id END AS tenant_id,
           CASE WHEN NOT json_valid(body) THEN body END AS dead_letter
         FROM messages""",
    "validate_documents": """SELECT CAST(doc_id AS VARCHAR) AS id, strlen(text) AS n_bytes,
           CASE WHEN text = '' THEN 'text is empty'
                WHEN strlen(text) > 8000 THEN 'text is too long' END AS reject_reason
         FROM documents""",
    "get_documents": given(CORPUS, REQUESTS)
    + f"""SELECT id, tenant_id, text, CAST(to_json(metadata) AS VARCHAR) AS metadata, status, model,
           {moment("created_at")}, {moment("updated_at")}
         FROM corpus c WHERE EXISTS (SELECT 1 FROM requests r
           WHERE r.id = c.id AND r.tenant_id = c.tenant_id)""",
    "jobs_fetch_text": given(CORPUS, CLICKS)
    + """SELECT c.id, c.text, count(*) AS n_jobs FROM clicks j JOIN corpus c ON c.id = j.document_id
         GROUP BY ALL""",
    "orphan_jobs": given(CORPUS, CLICKS)
    + """SELECT document_id, count(*) AS n_jobs FROM clicks
         WHERE document_id NOT IN (SELECT id FROM corpus) GROUP BY ALL""",
    "pending_backfill": given(CORPUS)
    + f"SELECT id AS document_id, tenant_id FROM corpus WHERE {pending('30 minutes')}",
    "pending_backfill_tenant": given(CORPUS)
    + f"""SELECT id AS document_id, tenant_id FROM corpus
          WHERE {pending('30 minutes')} AND tenant_id = 'src3'""",
    "pending_backfill_page": given(CORPUS)
    + f"""SELECT id AS document_id, tenant_id FROM corpus
          WHERE {pending('30 minutes')} AND id > '15' ORDER BY id LIMIT 100""",
    "validate_queries": given(TURNS)
    + """SELECT query_id, CASE WHEN query = '' THEN 'empty query' END AS reject_reason
         FROM turns""",
    "search_limit_clamp": given(TURNS)
    + """SELECT query_id, asked, CASE WHEN asked <= 0 THEN 10 WHEN asked > 100 THEN 100
           ELSE asked END AS given FROM turns""",
    "cosine_distance": given(CORPUS)
    + """SELECT id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]),
           (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance
         FROM corpus WHERE status = 'indexed'""",
    "search_topk": given(CORPUS)
    + """, scored AS (
           SELECT id, text, CAST(to_json(metadata) AS VARCHAR) AS metadata,
             list_cosine_similarity(CAST(embedding AS DOUBLE[]),
               (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s
           FROM corpus WHERE status = 'indexed' AND tenant_id = 'src0')
         SELECT id, text, metadata, round(s, 6) AS similarity FROM scored
         ORDER BY round(s, 12) DESC NULLS LAST, id LIMIT 10""",
    "search_topk_batch": given(CORPUS, vector_queries(LABEL_LIMIT), ranked()) + HITS,
    "search_topk_blocks": given(CORPUS, vector_queries(LABEL_LIMIT), ranked()) + HITS,
    "search_model_guard": given(CORPUS, vector_queries(), ranked("AND c.model = 'm1'")) + HITS,
    # The pruned search skips only cells that its bounds prove useless: its answer is exact.
    "search_ann": given(CORPUS, vector_queries(), ranked()) + HITS,
    "ann_recall": given(CORPUS, vector_queries(), ranked())
    + """SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, count(*) AS n_found,
           count(*) / count(*) AS recall FROM hits""",
    "search_model_skipped": given(CORPUS)
    + """SELECT tenant_id, count(*) AS n_indexed,
           count(*) FILTER (model IS DISTINCT FROM 'm1') AS n_skipped
         FROM corpus WHERE status = 'indexed' GROUP BY tenant_id""",
    "tenant_isolation": given(CORPUS, vector_queries(), ranked())
    + """SELECT asked_by AS tenant_id, count(*) AS n_results,
           count(*) FILTER (owner <> asked_by) AS n_foreign FROM hits GROUP BY asked_by""",
    "upsert_documents": given(CORPUS, BATCH)
    + f""", written AS (
           SELECT id, arg_max(tenant_id, seq) AS new_tenant, arg_max(text, seq) AS new_text,
             arg_max(metadata, seq) AS new_metadata, min(ts) AS first_at, max(ts) AS written_at
           FROM judged WHERE accepted GROUP BY id),
         merged AS (
           SELECT coalesce(c.id, w.id) AS id, coalesce(c.tenant_id, w.new_tenant) AS tenant_id,
             coalesce(w.new_text, c.text) AS text, coalesce(w.new_metadata, c.metadata) AS metadata,
             CASE WHEN w.id IS NULL THEN c.embedding END AS embedding,
             CASE WHEN w.id IS NULL THEN c.status ELSE 'pending' END AS status, c.model,
             coalesce(c.created_at, w.first_at) AS created_at,
             coalesce(w.written_at, c.updated_at) AS updated_at
           FROM corpus c FULL JOIN written w ON w.id = c.id)
         SELECT {STATE} FROM merged""",
    "upsert_quarantine": given(CORPUS, BATCH)
    + """SELECT seq, id, tenant_id, 'tenant_mismatch' AS reject_reason FROM judged
         WHERE NOT accepted""",
    "apply_embeddings": given(CORPUS, RESULTS)
    + f""", applied AS (
           SELECT c.id, c.tenant_id, c.text, c.metadata,
             coalesce(r.embedding, c.embedding) AS embedding,
             CASE WHEN r.id IS NULL THEN c.status ELSE 'indexed' END AS status,
             CASE WHEN r.id IS NULL THEN c.model ELSE 'm3' END AS model, c.created_at,
             CASE WHEN r.id IS NULL THEN c.updated_at ELSE {AS_OF} END AS updated_at
           FROM corpus c LEFT JOIN results r
             ON r.id = c.id AND r.text_hash = md5(c.text) AND r.error IS NULL)
         SELECT {STATE} FROM applied""",
    "mark_failed": given(CORPUS, RESULTS)
    + f""", marked AS (
           SELECT c.* REPLACE (
             CASE WHEN r.id IS NULL THEN c.status ELSE 'failed' END AS status,
             CASE WHEN r.id IS NULL THEN c.updated_at ELSE {AS_OF} END AS updated_at)
           FROM corpus c LEFT JOIN results r ON r.id = c.id AND r.error IS NOT NULL)
         SELECT {STATE} FROM marked""",
    "embed_outcomes": given(CORPUS, RESULTS)
    + """SELECT r.id, CASE WHEN c.id IS NULL THEN 'discarded'
             WHEN r.text_hash <> md5(c.text) THEN 'stale'
             WHEN r.error IS NULL THEN 'indexed'
             WHEN r.attempts_total >= 5 THEN 'failed' ELSE 'retry' END AS outcome,
           r.attempts_total, r.error
         FROM results r LEFT JOIN corpus c ON c.id = r.id""",
    "delete_documents": given(CORPUS, REQUESTS)
    + f"""SELECT {STATE} FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM requests r
            WHERE r.id = c.id AND r.tenant_id = c.tenant_id)""",
    "delete_report": given(CORPUS, REQUESTS)
    + """SELECT r.seq, r.id, r.tenant_id, c.id IS NOT NULL AND
             row_number() OVER (PARTITION BY r.id, r.tenant_id ORDER BY r.seq) = 1 AS deleted
         FROM requests r LEFT JOIN corpus c ON c.id = r.id AND c.tenant_id = r.tenant_id""",
    "document_lifecycle": given(CHANGES)
    + f""", live AS (
           SELECT id, 'src' || (user_id % 20) AS tenant_id, 'v' || last_seq AS text,
             MAP {{'type': kind}} AS metadata,
             CASE WHEN vector_value IS NOT NULL THEN [CAST(vector_value AS FLOAT)] END AS embedding,
             CASE last_op WHEN 'none' THEN 'pending' WHEN 'embed_ok' THEN 'indexed'
               ELSE 'failed' END AS status,
             'm' || (model_seq % 3) AS model, created_at, updated_at
           FROM folded)
         SELECT {STATE} FROM live""",
    "snapshot_contested": given(CORPUS, OWN_CHANGES, MERGED) + f"SELECT {STATE} FROM merged",
    "snapshot_quarantine": """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id,
           'other' AS tenant_id, CASE event_type WHEN 'click' THEN 'ingest' ELSE 'delete' END AS op,
           'tenant_mismatch' AS reject_reason
         FROM events WHERE event_type = 'click' OR (event_type = 'view' AND value >= 60)""",
    "snapshot_changes": given(CORPUS, CHANGES, MERGED) + f"SELECT {STATE} FROM merged",
    "reembed_candidates": given(CORPUS)
    + "SELECT id AS document_id, tenant_id, model AS old_model FROM corpus WHERE model <> 'm1'",
    "count_pending": given(CORPUS)
    + f"SELECT count(*) AS n_pending FROM corpus WHERE {pending('29 days')}",
    "count_pending_by_tenant": given(CORPUS)
    + f"""SELECT tenant_id, count(*) AS n_pending FROM corpus WHERE {pending('29 days')}
          GROUP BY tenant_id""",
    "backfill_summary": given(CORPUS)
    + f"""SELECT strftime({AS_OF} - INTERVAL '29 days', '%Y-%m-%dT%H:%M:%SZ') AS cutoff,
            count(*) AS total_pending, count(*) AS queued, false AS dry_run
          FROM corpus WHERE {pending('29 days')}""",
    "signal_stale_pending": given(CORPUS)
    + f"""SELECT count(*) AS n_pending, count(*) > 0 AS alert FROM corpus
          WHERE {pending('10 minutes')}""",
    "signal_latency_p99": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           count(*) AS n_requests, round(quantile_cont(value, 0.99), 6) AS p99,
           quantile_cont(value, 0.99) > 200 AS alert
         FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS w, value FROM events) GROUP BY w""",
    "signal_latency_p99_unknown": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           count(value) AS n_requests, round(quantile_cont(value, 0.99), 6) AS p99,
           quantile_cont(value, 0.99) > 200 AS alert
         FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS w,
                 CASE WHEN event_type <> 'error' THEN value END AS value FROM events) GROUP BY w""",
    "signal_error_rate": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
           count(*) AS n_calls, count(*) FILTER (failed) AS n_errors,
           round(avg(CAST(failed AS INT)), 6) AS error_rate,
           avg(CAST(failed AS INT)) > 0.05 AS alert
         FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS w, event_type = 'error' AS failed
               FROM events) GROUP BY w""",
    "signal_backlog": """WITH found AS (
           SELECT date_trunc('day', ts)::TIMESTAMP AS w,
             CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) AS BIGINT) AS net
           FROM events WHERE event_type IN ('click', 'purchase') GROUP BY w),
         buckets AS (
           SELECT c.w, coalesce(net, 0) AS net FROM (
             SELECT unnest(generate_series(min(w), max(w), INTERVAL 1 day)) AS w FROM found) c
           LEFT JOIN found USING (w)),
         depths AS (SELECT *, CAST(sum(net) OVER (ORDER BY w) AS BIGINT) AS depth FROM buckets)
         SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, net, depth,
           count(*) FILTER (depth > 5) OVER (ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
             = 3 AS alert
         FROM depths""",
    "signal_backlog_minutes": """WITH found AS (
           SELECT date_trunc('minute', ts)::TIMESTAMP AS w,
             CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) AS BIGINT) AS net
           FROM events WHERE event_type IN ('click', 'purchase') GROUP BY w),
         buckets AS (
           SELECT c.w, coalesce(net, 0) AS net FROM (
             SELECT unnest(generate_series(min(w), max(w), INTERVAL 1 minute)) AS w FROM found) c
           LEFT JOIN found USING (w)),
         depths AS (SELECT *, CAST(sum(net) OVER (ORDER BY w) AS BIGINT) AS depth FROM buckets)
         SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, net, depth,
           count(*) FILTER (depth > 5) OVER (ORDER BY w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
             = 5 AS alert
         FROM depths""",
    "hash_embedding": given(words(DOC_TEXTS))
    + """SELECT substr(id, 2) AS id, place, round(n / length, 6) AS weight
         FROM counts JOIN lengths USING (id)""",
    "embed_documents": given(words(DOC_TEXTS))
    + f"""SELECT substr(v.id, 2) AS id, md5(t.text) AS text_hash,
            {quantized("v.vector")} AS embedding, 1 AS attempts, CAST(NULL AS VARCHAR) AS error
          FROM vectors v JOIN texts t ON t.id = v.id""",
    "embed_batches": "SELECT count(*) AS n_texts, true AS within_limit FROM documents",
    "search_text_topk": given(
        words(DOC_TEXTS + " UNION ALL SELECT 'q' || item_id, text FROM benchmark")
    )
    + """, scored AS (
           SELECT b.item_id, d.doc_id, CASE WHEN list_sum(x.vector) > 0 AND list_sum(y.vector) > 0
             THEN list_cosine_similarity(x.vector, y.vector) END AS s
           FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20)
           JOIN vectors x ON x.id = 'q' || b.item_id JOIN vectors y ON y.id = 'd' || d.doc_id),
         ordered AS (
           SELECT *, row_number() OVER (PARTITION BY item_id
             ORDER BY round(s, 12) DESC NULLS LAST, CAST(doc_id AS VARCHAR)) AS rank FROM scored)
         SELECT CAST(item_id AS VARCHAR) AS query_id, rank, CAST(doc_id AS VARCHAR) AS id,
           round(s, 6) AS similarity FROM ordered WHERE rank <= 10""",
    "embed_jobs_dedup": dedup("5 days"),
    "embed_jobs_dedup_pieces": dedup("12 hours"),
    "tenant_fifo": given(CLICKS)
    + """SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id)
           AS position, event_id, document_id FROM clicks""",
    "expired_jobs": given(CLICKS)
    + f"""SELECT event_id, document_id, tenant_id, {moment("ts")} FROM clicks c
          WHERE c.ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL '4 days'""",
    "metadata_roundtrip": given(CORPUS)
    + """SELECT id, CAST(to_json(metadata) AS VARCHAR) AS plain, md5(text) AS text_hash, lang,
           3 AS n_keys FROM corpus""",
    "query_fingerprint": given(vector_queries(LABEL_LIMIT))
    + f"SELECT query_id, tenant_id, {FINGERPRINT} AS cache_key FROM queries",
    "search_response_json": given(CORPUS, vector_queries("3"), ranked())
    + """SELECT query_id, '{"results":[' || string_agg(
           '{"document_id":"' || id || '","text":' || CAST(to_json(text) AS VARCHAR) ||
           ',"metadata":' || CAST(to_json(metadata) AS VARCHAR) || ',"similarity":' ||
           CAST(CAST(round(similarity, 6) AS DECIMAL(9,6)) AS VARCHAR) || '}', ',' ORDER BY rank)
           || ']}' AS response
         FROM hits GROUP BY query_id""",
    "search_result_counts": given(CORPUS, vector_queries(LABEL_LIMIT), ranked())
    + """SELECT q.query_id, q.tenant_id, count(h.id) AS n_results
         FROM queries q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY ALL""",
    "cached_search": given(CORPUS, vector_queries(), ranked())
    + """SELECT query_id, rank, id, round(similarity, 6) AS similarity, label * 30 < 120
           AS from_cache FROM hits""",
    "invalidate_tenants": given(CORPUS, vector_queries(), ranked(), CLICKS)
    + f""", keyed AS (SELECT query_id, tenant_id, {FINGERPRINT} AS cache_key FROM queries)
         SELECT q.cache_key, q.tenant_id, count(h.id) AS n_results
         FROM keyed q LEFT JOIN hits h ON h.query_id = q.query_id
         WHERE q.tenant_id NOT IN (SELECT tenant_id FROM clicks) GROUP BY ALL""",
}
ORACLE["lifecycle_replayed"] = ORACLE["document_lifecycle"]
ORACLE["cached_search_merged"] = ORACLE["cached_search"]
ORACLE["search_text_rejects"] = """
SELECT CAST(item_id AS VARCHAR) AS query_id, 'src' || (item_id % 20) AS tenant_id,
  CASE WHEN item_id % 7 = 0 OR text = '' THEN 'empty query' ELSE 'cannot embed' END AS reject_reason
FROM benchmark WHERE item_id % 7 = 0 OR text = '' OR length(text) % 3 = 0"""
