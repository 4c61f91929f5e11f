import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from docfathom.operators import lifecycle
from docfathom.schemas import CHANGE, DOCUMENTS

START = dt.datetime(2024, 1, 1)


def log(spark, ops):
    """Rows ``(op, id, tenant)``; text, vector and time follow from the position."""
    rows = []
    for seq, (op, id_, tenant) in enumerate(ops):
        at = START + dt.timedelta(minutes=seq)
        ingest, ok = op == "ingest", op == "embed_ok"
        rows.append(
            (
                seq, at, op, id_, tenant,
                f"v{seq}" if ingest else None, {"n": str(seq)} if ingest else None,
                [float(seq)] if ok else None, f"m{seq}" if ok else None, None,
            )
        )
    return spark.createDataFrame(rows, CHANGE)


def slow_fold(ops):
    live, rejected = {}, []
    for seq, (op, id_, tenant) in enumerate(ops):
        at = START + dt.timedelta(minutes=seq)
        doc = live.get(id_)
        if op == "ingest":
            if doc and doc["tenant_id"] != tenant:
                rejected.append(seq)
                continue
            if not doc:
                doc = live[id_] = {"tenant_id": tenant, "created_at": at, "model": None}
            doc.update(
                text=f"v{seq}", metadata={"n": str(seq)}, embedding=None, status="pending", updated_at=at
            )
        elif op == "delete":
            if doc and doc["tenant_id"] == tenant:
                del live[id_]
            elif doc:
                rejected.append(seq)
        elif doc and op == "embed_ok":
            doc.update(embedding=[float(seq)], model=f"m{seq}", status="indexed", updated_at=at)
        elif doc:
            doc.update(status="failed", updated_at=at)
    return live, rejected


def as_dict(df):
    return {r.id: {k: v for k, v in r.asDict().items() if k != "id"} for r in df.collect()}


def random_ops(seed, n, tenants):
    rng = random.Random(seed)
    kinds = ["ingest"] * 4 + ["embed_ok"] * 3 + ["embed_fail"] * 2 + ["delete"] * 2
    ops = []
    for _ in range(n):
        op, id_ = rng.choice(kinds), f"d{rng.randrange(12)}"
        tenant = rng.choice(tenants) if op in ("ingest", "delete") else None
        ops.append((op, id_, tenant))
    return ops


def test_fold_equals_step_by_step(spark):
    for seed in (1, 2, 3):
        ops = random_ops(seed, 150, ["a"])
        assert as_dict(lifecycle.document_lifecycle(log(spark, ops))) == slow_fold(ops)[0]


def test_fold_with_contested_ids(spark):
    for seed in (4, 5):
        ops = random_ops(seed, 200, ["a", "a", "b"])
        live, rejected = slow_fold(ops)
        accepted, refused = lifecycle.split_contested(log(spark, ops))
        assert sorted(r.seq for r in refused.collect()) == rejected and rejected
        assert as_dict(lifecycle.document_lifecycle(accepted)) == live


def test_snapshot_and_tail_equal_one_log(spark):
    ops = random_ops(6, 220, ["a"])
    whole = log(spark, ops)
    for cut in (40, 110, 180):
        snapshot = lifecycle.document_lifecycle(whole.filter(F.col("seq") < cut))
        after = lifecycle.apply_changes(snapshot, whole.filter(F.col("seq") >= cut))
        assert as_dict(after) == slow_fold(ops)[0]


def test_vector_of_an_older_text_is_ignored(spark):
    ops = [("ingest", "d", "a"), ("ingest", "d", "a"), ("embed_ok", "d", None)]
    changes = log(spark, ops).withColumn(
        "text_hash", F.when(F.col("op") == "embed_ok", F.md5(F.lit("v0")))
    )
    doc = as_dict(lifecycle.document_lifecycle(changes))["d"]
    assert doc["status"] == "pending" and doc["embedding"] is None
    right = changes.withColumn("text_hash", F.when(F.col("op") == "embed_ok", F.md5(F.lit("v1"))))
    assert as_dict(lifecycle.document_lifecycle(right))["d"]["status"] == "indexed"


def snapshot(spark, rows):
    return spark.createDataFrame(
        [(i, t, x, {"k": "1"}, [1.0], "indexed", "m0", START, START) for i, t, x in rows], DOCUMENTS
    )


def batch(spark, rows):
    at = START + dt.timedelta(days=1)
    return spark.createDataFrame(
        [(s, at + dt.timedelta(seconds=s), i, t, x, m) for s, i, t, x, m in rows],
        "seq long, ts timestamp, id string, tenant_id string, text string, metadata map<string,string>",
    )


def test_upsert(spark):
    base = snapshot(spark, [("1", "a", "old"), ("2", "a", "kept"), ("3", "b", "theirs")])
    new = batch(
        spark,
        [
            (1, "1", "a", "new", None),
            (2, "1", "a", "newer", {"x": "y"}),
            (3, "3", "a", "stolen", {}),
            (4, "9", "b", "first", {}),
            (5, "9", "a", "second", {}),
        ],
    )
    after = as_dict(lifecycle.upsert_documents(base, new))
    assert after["1"]["text"] == "newer" and after["1"]["metadata"] == {"x": "y"}
    assert after["1"]["status"] == "pending" and after["1"]["embedding"] is None
    assert after["1"]["model"] == "m0" and after["1"]["created_at"] == START
    assert after["2"] == as_dict(base)["2"] and after["3"]["text"] == "theirs"
    assert after["9"]["tenant_id"] == "b" and after["9"]["text"] == "first"
    _, refused = lifecycle.split_by_owner(base, new)
    assert sorted((r.seq, r.reject_reason) for r in refused.collect()) == [
        (3, "tenant_mismatch"), (5, "tenant_mismatch"),
    ]
    again = lifecycle.upsert_documents(lifecycle.upsert_documents(base, new), new)
    assert as_dict(again) == after


def test_upsert_with_empty_metadata(spark):
    after = as_dict(
        lifecycle.upsert_documents(snapshot(spark, []), batch(spark, [(1, "1", "a", "x", None)]))
    )
    assert after["1"]["metadata"] == {}


def test_delete_is_scoped_and_reported_once(spark):
    base = snapshot(spark, [("1", "a", "x"), ("2", "a", "y")])
    asked = spark.createDataFrame(
        [(1, "1", "b"), (2, "1", "a"), (3, "1", "a"), (4, "7", "a")], "seq long, id string, tenant_id string"
    )
    assert [r.id for r in lifecycle.delete_documents(base, asked).collect()] == ["2"]
    report = {r.seq: r.deleted for r in lifecycle.delete_report(base, asked).collect()}
    assert report == {1: False, 2: True, 3: False, 4: False}


def test_a_pending_document_can_be_read(spark):
    base = snapshot(spark, [("1", "a", "x")]).withColumn("model", F.lit(None).cast("string"))
    asked = spark.createDataFrame([("1", "a"), ("1", "a"), ("1", "b")], "id string, tenant_id string")
    found = lifecycle.get_documents(base, asked).collect()
    assert len(found) == 1 and found[0].model is None


def test_validation_counts_bytes(spark):
    rows = [("1", "é" * 50_000), ("2", "é" * 50_000 + "x"), ("3", ""), ("", "x"), ("4", None)]
    frame = spark.createDataFrame(rows, "id string, text string")
    reasons = {
        (r.id, r.reject_reason) for r in lifecycle.validate_documents(frame).collect()
    }
    assert reasons == {
        ("1", None), ("2", "text is too long"), ("3", "text is empty"),
        ("", "missing document_id"), ("4", "text is empty"),
    }


def test_ownership_and_redelivery(spark):
    """Owners of a snapshot, equal moments, repeated changes and stale models at once."""
    base = snapshot(spark, [("1", "a", "mine")])
    ops = [
        (1, "ingest", "1", "b", "theirs", None, None),
        (2, "delete", "1", "b", None, None, None),
        (3, "ingest", "2", "b", "late", None, None),
        (3, "ingest", "2", "a", "first", None, None),
        (4, "ingest", "3", "a", "old", None, None),
        (5, "embed_ok", "3", None, None, "good", "old"),
        (6, "ingest", "3", "a", "new", None, None),
        (7, "embed_ok", "3", None, None, "stale", "old"),
    ]
    rows = [
        (s, START, op, i, t, x, {} if x else None, [1.0] if m else None, m, hashlib.md5(h.encode()).hexdigest() if h else None)
        for s, op, i, t, x, m, h in ops
    ]
    changes = spark.createDataFrame(
        rows + rows,
        "seq long, ts timestamp, op string, id string, tenant_id string, text string, "
        "metadata map<string,string>, embedding array<float>, model string, text_hash string",
    )
    live = lifecycle.apply_changes(base, changes).collect()
    assert sorted((r.id, r.tenant_id, r.text, r.status, r.model) for r in live) == [
        ("1", "a", "mine", "indexed", "m0"),
        ("2", "a", "first", "pending", None),
        ("3", "a", "new", "pending", "good"),
    ]
    refused = {(r.seq, r.id, r.tenant_id) for r in lifecycle.refused_changes(base, changes).collect()}
    assert refused == {(1, "1", "b"), (2, "1", "b"), (3, "2", "b")}


def test_a_snapshot_is_evaluated_once_for_the_log_and_once_for_the_rest(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    at = F.lit("2024-01-01").cast("timestamp")
    n = 20
    snapshot = spark.range(n).select(
        F.col("id").cast("string"),
        F.lit("t").alias("tenant_id"),
        F.udf(counted, "string")(F.concat(F.lit("x"), F.col("id"))).alias("text"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"),
        F.lit("indexed").alias("status"),
        F.lit("m1").alias("model"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    changes = spark.range(n).select(
        F.col("id").alias("seq"),
        at.alias("ts"),
        F.when(F.col("id") % 4 == 0, "delete").when(F.col("id") % 4 == 1, "ingest").otherwise("embed_fail").alias("op"),
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 8 < 4, "t").otherwise("other").alias("tenant_id"),
        F.lit("new").alias("text"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("text_hash"),
    )
    got = {r.id: (r.text, r.status) for r in lifecycle.apply_changes(snapshot, changes).collect()}
    want = {}
    for i in range(n):
        if i % 8 != 0:
            if i % 8 == 1:
                want[str(i)] = ("new", "pending")
            else:
                want[str(i)] = (f"x{i}", "failed" if i % 4 > 1 else "indexed")
    assert got == want
    assert seen.value <= 2 * n


def test_stored_vectors_leave_documents_that_lie_by_id_in_place(spark, monkeypatch, tmp_path):
    monkeypatch.setattr("docfathom.operators.spread.SENT_ROWS", 0)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(str(i), f"x{i}") for i in range(20)] + [("3", "twin"), (None, "x")]
        corpus = spark.createDataFrame(rows, "id string, text string").selectExpr(
            "id", "'t' tenant_id", "text", "map('k', 'v') metadata", "cast(null as array<float>) embedding",
            "'pending' status", "cast(null as string) model", "timestamp'2024-01-01' created_at",
            "timestamp'2024-01-01' updated_at",
        )
        results = spark.createDataFrame(
            [("3", "x3", 1.0), ("3", "x3", 1.0), ("3", "twin", 2.0), ("4", "old", 3.0), ("5", "x5", None), (None, "x", 4.0)],
            "id string, text string, v float",
        ).selectExpr(
            "id", "md5(text) text_hash", "if(v is null, null, array(v)) embedding", "'m' model",
            "cast(null as string) error",
        )
        done = lifecycle.apply_embeddings(
            corpus.repartition(4, "id"), results.repartition(4, "id"), F.lit("2024-02-01").cast("timestamp")
        )
        assert "ENSURE_REQUIREMENTS" not in done._jdf.queryExecution().executedPlan().toString()
        rows = done.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(rows) == 22
    assert {(r.id, r.text): r.embedding for r in rows if r.embedding} == {("3", "x3"): [1.0], ("3", "twin"): [2.0]}
