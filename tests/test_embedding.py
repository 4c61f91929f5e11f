import numpy as np
import pytest
from pyspark.sql import functions as F

from docfathom.operators import embedding as emb
from docfathom.operators.embedding import (
    HashEmbedder,
    PermanentEmbedError,
    RetryableEmbedError,
    call_with_retry,
    embed_batch,
    embed_documents,
)


class Fake:
    """Fails ``failures`` times, then gives 4 values per text, the first telling its place."""

    def __init__(self, failures=0, error=RetryableEmbedError("status 429")):
        self.failures, self.error, self.calls, self.sizes = failures, error, 0, []

    def __call__(self, texts):
        self.calls += 1
        self.sizes.append(len(texts))
        if self.calls <= self.failures:
            raise self.error
        return [[i + 0.1, 0.0, 0.0, 0.0] for i in range(len(texts))]


def test_success_and_order():
    vectors, attempts = call_with_retry(Fake(), ["a", "b", "c", "d"], dims=4)
    assert [v[0] for v in vectors] == [0.1, 1.1, 2.1, 3.1] and attempts == 1


@pytest.mark.parametrize("failures, error", [
    (2, RetryableEmbedError("status 429")),
    (1, RetryableEmbedError("status 500")),
    (1, ConnectionError("reset")),
])
def test_retry(failures, error):
    waits, fake = [], Fake(failures, error)
    _, attempts = call_with_retry(fake, ["a"], sleep=waits.append)
    assert attempts == failures + 1 == fake.calls
    for n, wait in enumerate(waits):
        assert 2**n <= wait <= 2**n + 0.2


def test_retry_budget():
    fake, waits = Fake(99), []
    with pytest.raises(RetryableEmbedError, match="after 5 calls"):
        call_with_retry(fake, ["a"], sleep=waits.append)
    assert fake.calls == 5 and len(waits) == 4


def test_permanent_error_is_not_retried():
    fake = Fake(99, PermanentEmbedError("bad request 400"))
    assert embed_batch(fake, ["a"]) == [(None, "bad request 400", 1)] and fake.calls == 1


def test_short_or_wrong_replies_are_errors():
    with pytest.raises(PermanentEmbedError):
        call_with_retry(lambda texts: [[1.0]], ["a", "b"])
    with pytest.raises(PermanentEmbedError):
        call_with_retry(lambda texts: [[1.0]] * 2, ["a", "b"], dims=2)


def test_only_the_bad_text_fails():
    def picky(texts):
        if "bad" in texts:
            raise PermanentEmbedError("cannot embed")
        return [[float(len(t))] for t in texts]

    texts = [f"t{n}" for n in range(13)] + ["bad"] + ["last"]
    done = embed_batch(picky, texts)
    assert [error for _, error, _ in done] == [None] * 13 + ["cannot embed", None]
    assert [v[0] for v, e, _ in done if e is None] == [float(len(t)) for t in texts if t != "bad"]


def test_batches_are_full_whatever_arrow_gives(spark):
    docs = spark.createDataFrame([(str(n), f"text {n}") for n in range(250)], "id string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        rows = embed_documents(docs.coalesce(1), HashEmbedder(8), 8, batch_size=100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted({r.batch_size for r in rows}) == [50, 100] and len(rows) == 250
    expected = HashEmbedder(8)(["text 7"])[0]
    assert next(r.embedding for r in rows if r.id == "7") == pytest.approx(list(expected))


def test_failures_become_rows(spark):
    def broken(texts):
        if any("3" in t for t in texts):
            raise PermanentEmbedError("no threes")
        raise RetryableEmbedError("busy")

    docs = spark.createDataFrame([(str(n), f"text {n}") for n in range(4)], "id string, text string")
    rows = embed_documents(docs.coalesce(1), broken, sleep=lambda s: None).collect()
    by_id = {r.id: r for r in rows}
    assert by_id["3"].error == "no threes" and by_id["3"].attempts == 1
    assert by_id["0"].attempts == 5 and "busy" in by_id["0"].error
    assert all(r.embedding is None for r in rows)


def test_hash_embedder_equals_column_form(spark):
    texts = ["one two two", "", " \t\n", "ünï çödé ünï", "a b  c\r\nd"]
    docs = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "id string, text string")
    want = {}
    for n, vector in enumerate(HashEmbedder(16)(texts)):
        for place in np.nonzero(vector)[0]:
            want[str(n), int(place)] = round(float(vector[place]), 6)
    got = {(r.id, r.place): round(r.weight, 6) for r in emb.hash_weights(docs, 16).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_hash_weights_shuffle_no_text(spark, tmp_path):
    rows = [("a", "red kite red"), ("b", None), ("c", ""), ("d", "  \t ")]
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "t"))
    weights = emb.hash_weights(spark.read.parquet(str(tmp_path / "t")), 16)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = {(r.id, r.place): r.weight for r in weights.collect()}
    assert {i for i, _ in got} == {"a"}
    want = emb.HashEmbedder(16)(["red kite red"])[0]
    assert all(abs(got.get(("a", p), 0.0) - float(want[p])) < 1e-6 for p in range(16))


def test_hash_weights_hash_a_word_once(spark):
    docs = spark.range(1).select(F.col("id").cast("string"), F.lit("x").alias("text"), F.rand().alias("r"))
    weights = emb.hash_weights(docs.withColumn("text", F.concat("text", F.col("r").cast("string"))), 16)
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    # Nor may the counting of a place stand in the lambda that goes over all places.
    assert plan.count("md5(") == 1 and "sequence(" not in plan

    words = [f"w{n % 977}" for n in range(20_000)]
    long = spark.createDataFrame([("a", " ".join(words))], "id string, text string")
    want = HashEmbedder(64)([" ".join(words)])[0]
    got = {r.place: r.weight for r in emb.hash_weights(long).collect()}
    assert all(abs(got.get(p, 0.0) - float(want[p])) < 1e-6 for p in range(64))


def test_remembered_words_stay_bounded():
    embedder, plain = HashEmbedder(16), HashEmbedder(16)
    embedder.KNOWN_WORDS = 10
    texts = [" ".join(f"w{n}" for n in range(a, a + 30)) + " " + "x" * 5000 for a in range(0, 120, 30)]
    got = embedder(texts)
    assert len(embedder.known) <= 10 and all(len(word) <= 64 for word in embedder.known)
    assert HashEmbedder.KNOWN_WORDS <= 100_000
    assert all((a == b).all() for a, b in zip(got, plain(texts)))


def test_queries_send_batches_of_bounded_size(spark, sf_dir):
    from docfathom.plans.registry import QUERIES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        QUERIES["embed_documents"](spark, sf_dir)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.set(key, kept) if kept else spark.conf.unset(key)
