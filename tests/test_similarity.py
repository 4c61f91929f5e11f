import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfathom.functions.vectors import cosine_distance
from docfathom.operators import ann, similarity
from docfathom.operators.similarity import search_topk, search_topk_batch
from docfathom.schemas import DOCUMENTS

NOW = dt.datetime(2024, 1, 1)


def floats(vector):
    return None if vector is None else [float(x) for x in vector]


def docs(spark, rows):
    """Rows ``(id, tenant, vector)``; without a vector a document is pending."""
    return spark.createDataFrame(
        [
            (i, t, f"text of {i}", {}, floats(v), "pending" if v is None else "indexed", "m", NOW, NOW)
            for i, t, v in rows
        ],
        DOCUMENTS,
    )


def asked(spark, rows):
    return spark.createDataFrame(
        [(q, t, floats(v), k) for q, t, v, k in rows],
        "query_id string, tenant_id string, query_vec array<float>, limit int",
    )


@pytest.fixture(params=["arrow", "columns", "sent", "blocks"])
def search(request, spark):
    def one(corpus, tenant, vector, limit):
        if request.param in ("arrow", "columns"):
            found = search_topk(corpus, tenant, vector, limit, arrow=request.param == "arrow")
            return [(r.id, r.similarity) for r in found.collect()]
        queries = asked(spark, [("q", tenant, vector, limit)])
        sent = 1 << 20 if request.param == "sent" else 0
        found = search_topk_batch(corpus, queries, sent_query_bytes=sent, block_rows=2)
        return [(r.id, r.similarity) for r in found.orderBy("rank").collect()]

    return one


def test_ranking(spark, search):
    corpus = docs(
        spark, [("doc-1", "a", [1.0, 0, 0]), ("doc-2", "a", [0, 1.0, 0]), ("doc-3", "a", [0, 0, 1.0])]
    )
    found = search(corpus, "a", [0.9, 0.1, 0.0], 3)
    assert [i for i, _ in found] == ["doc-1", "doc-2", "doc-3"]
    assert [round(s, 4) for _, s in found] == [0.9939, 0.1104, 0.0]


def test_isolation(spark, search):
    corpus = docs(spark, [("b-doc", "b", [1.0, 0, 0]), ("a-doc", "a", [0, 1.0, 0])])
    assert [i for i, _ in search(corpus, "a", [1.0, 0, 0], 10)] == ["a-doc"]


def test_pending_is_hidden(spark, search):
    assert search(docs(spark, [("p", "a", None)]), "a", [1.0, 0, 0], 10) == []


def test_zero_and_odd_vectors_come_last(spark, search):
    corpus = docs(
        spark,
        [("zero", "a", [0.0, 0, 0]), ("odd", "a", [1.0, 0]), ("far", "a", [-1.0, 0, 0]), ("near", "a", [1.0, 0, 0])],
    )
    found = search(corpus, "a", [1.0, 0, 0], 10)
    assert [i for i, _ in found] == ["near", "far", "odd", "zero"]
    assert [s for _, s in found][2:] == [None, None]


def test_copies_are_ordered_by_id(spark, search):
    rng = np.random.default_rng(3)
    vector = [float(x) for x in rng.normal(size=33)]
    names = [f"d{n}" for n in rng.permutation(60)]
    corpus = docs(spark, [(name, "a", vector) for name in names])
    found = search(corpus, "a", [float(x) for x in rng.normal(size=33)], 7)
    assert [i for i, _ in found] == sorted(names)[:7]


@pytest.mark.parametrize("limit, given", [(-1, 10), (0, 10), (1, 1), (100, 100), (101, 100)])
def test_limits(spark, search, limit, given):
    corpus = docs(spark, [(f"d{n:03}", "a", [1.0, float(n)]) for n in range(120)])
    assert len(search(corpus, "a", [1.0, 0.0], limit)) == given


@pytest.mark.parametrize("sent, block", [(1 << 20, 4096), (0, 3), (0, 50)])
def test_batch_equals_brute_force(spark, sent, block):
    rng = np.random.default_rng(11)
    # One tenant holds most documents and most queries.
    tenants = ["big"] * 150 + [f"t{n % 5}" for n in range(40)]
    vectors = rng.normal(size=(len(tenants), 12)).astype(np.float32)
    rows = [(f"d{n}", t, [float(x) for x in v]) for n, (t, v) in enumerate(zip(tenants, vectors))]
    wanted = [
        (f"q{n}", "big" if n % 3 else f"t{n % 7}", [float(x) for x in rng.normal(size=12)], n % 12 + 1)
        for n in range(60)
    ]
    wanted = [(q, t, [float(np.float32(x)) for x in v], k) for q, t, v, k in wanted]
    found = search_topk_batch(
        docs(spark, rows).repartition(7), asked(spark, wanted), sent_query_bytes=sent, block_rows=block
    )
    got = {}
    for row in found.orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.id)
    expected = {}
    for q, t, v, k in wanted:
        scored = [
            (-np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, dt_, w in rows if dt_ == t
        ]
        if scored:
            expected[q] = [i for _, i in sorted(scored)[:k]]
    assert got == expected


def test_distance_of_a_zero_vector_is_null(spark):
    frame = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert frame.select(cosine_distance(F.col("a"), F.col("b"))).first()[0] is None


def test_model_guard(spark):
    corpus = docs(spark, [("x", "a", [1.0, 0]), ("y", "a", [1.0, 0])])
    corpus = corpus.withColumn("model", F.when(F.col("id") == "x", "m1").otherwise("m2"))
    queries = asked(spark, [("q", "a", [1.0, 0.0], 5)]).withColumn("model", F.lit("m2"))
    assert [r.id for r in similarity.search_same_model(corpus, queries).collect()] == ["y"]
    assert similarity.other_model_counts(corpus, "m2").collect()[0].n_skipped == 1


def test_ann_with_all_cells_is_exact(spark):
    rng = np.random.default_rng(5)
    corpus = docs(
        spark, [(f"d{n}", "ab"[n % 2], rng.normal(size=6)) for n in range(80)]
    )
    queries = asked(spark, [(f"q{n}", "ab"[n % 2], rng.normal(size=6), 5) for n in range(9)])
    centres = ann.train_cells(corpus, cells=4)
    exact = {tuple(r) for r in search_topk_batch(corpus, queries).select("query_id", "rank", "id").collect()}
    every = ann.search_ann(corpus, queries, centres, nprobe=len(centres))
    assert {tuple(r) for r in every.select("query_id", "rank", "id").collect()} == exact
    some = ann.ann_recall(
        search_topk_batch(corpus, queries), ann.search_ann(corpus, queries, centres, nprobe=2)
    ).first()
    assert some.n_exact == 45 and 0.2 < some.recall <= 1


def test_search_reads_only_what_it_needs(spark, tmp_path):
    corpus = docs(spark, [(f"d{n}", "ab"[n % 2], [1.0, float(n)]) for n in range(20)])
    corpus.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    plan = search_topk_batch(stored, asked(spark, [("q", "a", [1.0, 0.0], 3)]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "EqualTo(status,indexed)" in scan and "tenant_id" in scan.split("PushedFilters")[1]
    assert "text" not in scan.split("ReadSchema")[1]


def test_blocks_of_very_many_cells(spark, monkeypatch):
    """Beyond the cells whose layout is broadcast, a salted join places the rows."""
    rng = np.random.default_rng(8)
    corpus = docs(spark, [(f"d{n}", f"t{n % 4}", rng.normal(size=5)) for n in range(60)])
    queries = asked(spark, [(f"q{n}", f"t{n % 5}", rng.normal(size=5), 4) for n in range(20)])
    want = {tuple(r)[:3] for r in search_topk_batch(corpus, queries).collect()}
    monkeypatch.setattr(similarity, "SENT_CELLS", 0)
    found = search_topk_batch(corpus, queries, sent_query_bytes=0, block_rows=6)
    assert {tuple(r)[:3] for r in found.collect()} == want
    monkeypatch.setattr(similarity, "SENT_QUERY_BYTES", 1 << 20)
    monkeypatch.setattr(similarity, "FILTERED_CELLS", 0)
    assert {tuple(r)[:3] for r in search_topk_batch(corpus, queries).collect()} == want


def test_pruned_search_is_exact(spark):
    rng = np.random.default_rng(11)
    centres_true = rng.normal(size=(6, 8)) * 4
    rows = [(f"d{n}", "ab"[n % 2], centres_true[n % 6] + rng.normal(size=8)) for n in range(240)]
    rows += [("zero", "a", np.zeros(8)), ("short", "b", np.ones(3)), ("tie1", "a", centres_true[0]), ("tie2", "a", centres_true[0])]
    corpus = docs(spark, rows)
    asks = [(f"q{n}", "ab"[n % 2], centres_true[n % 6] + rng.normal(size=8), 5) for n in range(30)]
    asks += [("qz", "a", np.zeros(8), 3), ("qs", "b", np.ones(3), 3), ("qt", "a", centres_true[0], 4)]
    queries = asked(spark, asks)
    centres = ann.train_cells(corpus, cells=6)
    exact = {tuple(r) for r in search_topk_batch(corpus, queries).select("query_id", "rank", "id").collect()}
    for first in (1, 2, 6):
        found = ann.search_pruned(corpus, queries, centres, first_cells=first)
        assert {tuple(r) for r in found.select("query_id", "rank", "id").collect()} == exact
    recall = ann.ann_recall(search_topk_batch(corpus, queries), ann.search_pruned(corpus, queries, centres)).first()
    assert recall.recall == 1.0


def test_equal_scores_leave_k_rows_a_query():
    import pyarrow as pa

    ids = pa.array([f"d{n:05}" for n in range(10_000)][::-1])
    scores = np.full((100, 10_000), 0.5)
    scores[3, 17] = 0.9
    found = similarity._candidates(scores, ids, 10, 0)
    assert found.num_rows == 1000
    rows = found.to_pydict()
    mine = sorted(i for q, i in zip(rows["query"], rows["id"]) if q == 0)
    assert mine == [f"d{n:05}" for n in range(10)]
    third = {i for q, i in zip(rows["query"], rows["id"]) if q == 3}
    assert ids[17].as_py() in third and len(third) == 10
    with_null = pa.array(["b", None, "a", "c"])
    picked = similarity._candidates(np.zeros((1, 4)), with_null, 2, 0).to_pydict()["id"]
    assert sorted(picked) == ["a", "b"]
