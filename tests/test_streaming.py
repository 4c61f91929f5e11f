import datetime as dt
import json

import pytest
from pyspark.sql import Window, functions as F

from docfathom.operators.embedding import HashEmbedder, PermanentEmbedError
from docfathom.operators.jobs import dedup_jobs
from docfathom.operators.similarity import search_topk
from docfathom.sources.documents import tenant_documents, write_documents
from docfathom.sources.messages import read_messages
from docfathom.streaming import changelog, embed, ingest
from docfathom.streaming.dedup import dedup_stream

START = dt.datetime(2024, 1, 1)


def request(id_, text, tenant="a", minute=0, **metadata):
    at = (START + dt.timedelta(minutes=minute)).isoformat() + "Z"
    return {"document_id": id_, "tenant_id": tenant, "text": text, "metadata": metadata, "ts": at}


class Collection:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, folder, 0
        self.root = str(folder / "root")
        (folder / "in").mkdir()

    def send(self, *requests):
        self.files += 1
        lines = [r if isinstance(r, str) else json.dumps(r) for r in requests]
        (self.folder / "in" / f"{self.files:03}.json").write_text("\n".join(lines) + "\n")

    def ingest(self):
        stream = read_messages(
            self.spark, str(self.folder / "in"), changelog.REQUEST, stream=True, max_files=1
        )
        ingest.start_ingest(stream, self.root, str(self.folder / "c1")).awaitTermination()

    def embed(self, embedder=None, **options):
        embed.start_embedding(
            embed.read_jobs(self.spark, self.root),
            self.root,
            str(self.folder / "c2"),
            embedder or HashEmbedder(16),
            "m1",
            sleep=lambda seconds: None,
            **options,
        ).awaitTermination()

    def documents(self):
        rows = changelog.current_documents(self.spark, self.root).collect()
        return {r.id: r.asDict() for r in rows}


@pytest.fixture
def collection(spark, tmp_path):
    return Collection(spark, tmp_path)


def test_from_request_to_search(spark, collection):
    collection.send(request("1", "red kite in the wind"), request("2", "tide table"), "{broken", request("3", ""))
    collection.send(request("1", "red kite", minute=1, k="v"), request("9", "kite", tenant="b"))
    collection.ingest()
    docs = collection.documents()
    assert {i: d["status"] for i, d in docs.items()} == {"1": "pending", "2": "pending", "9": "pending"}
    assert docs["1"]["text"] == "red kite" and docs["1"]["metadata"] == {"k": "v"}
    rejects = spark.read.parquet(f"{collection.root}/rejects").collect()
    assert sorted(r.reject_reason for r in rejects) == ["invalid JSON", "text is empty"]
    collection.embed()
    docs = collection.documents()
    assert {d["status"] for d in docs.values()} == {"indexed"}
    corpus = changelog.current_documents(spark, collection.root)
    vector = [float(x) for x in HashEmbedder(16)(["red kite"])[0]]
    found = search_topk(corpus, "a", vector).collect()
    assert [r.id for r in found][0] == "1" and {r.id for r in found} == {"1", "2"}

    # A re-ingest hides the document until it is embedded again.
    collection.send(request("1", "harbour", minute=10))
    collection.ingest()
    assert collection.documents()["1"]["status"] == "pending"
    assert collection.documents()["1"]["model"] == "m1"
    changelog.delete_batch(
        spark.createDataFrame(
            [("2", "a", START + dt.timedelta(minutes=20)), ("9", "a", START + dt.timedelta(minutes=20))],
            "document_id string, tenant_id string, ts timestamp",
        ),
        collection.root,
        0,
    )
    collection.embed()
    docs = collection.documents()
    assert set(docs) == {"1", "9"} and docs["1"]["status"] == "indexed"

    # A written snapshot holds the same rows, one tenant at a time.
    path = str(collection.folder / "snapshot")
    write_documents(changelog.current_documents(spark, collection.root), path, files=3)
    assert [r.id for r in tenant_documents(spark, path, "b").collect()] == ["9"]


def test_repeated_batches_change_nothing(spark, collection):
    collection.send(request("1", "one"), request("2", "two"))
    collection.ingest()
    collection.embed()
    before = collection.documents()
    batch = read_messages(spark, str(collection.folder / "in"), changelog.REQUEST)
    ingest.ingest_batch(batch, 0, collection.root)
    jobs = spark.read.schema(changelog.JOB).json(f"{collection.root}/jobs")
    again = jobs.withColumn("processed_at", F.lit(before["1"]["updated_at"]))
    for _ in range(2):
        embed.embed_jobs(again, 0, collection.root, HashEmbedder(16), "m1")
    assert collection.documents() == before
    assert jobs.count() == 2


def test_vector_of_a_replaced_text_is_ignored(spark, collection):
    collection.send(request("1", "old"))
    collection.ingest()
    jobs = spark.read.schema(changelog.JOB).json(f"{collection.root}/jobs").withColumn(
        "processed_at", F.lit(START)
    )
    jobs = spark.createDataFrame(jobs.collect(), jobs.schema)
    collection.send(request("1", "new", minute=10))
    collection.ingest()
    embed.embed_jobs(jobs, 0, collection.root, HashEmbedder(16), "m1")
    assert collection.documents()["1"]["status"] == "pending"


def test_failed_documents_and_backfill(spark, collection):
    def picky(texts):
        if any("bad" in text for text in texts):
            raise PermanentEmbedError("cannot embed")
        return HashEmbedder(16)(texts)

    collection.send(request("1", "good"), request("2", "bad"))
    collection.ingest()
    collection.embed(picky)
    assert {i: d["status"] for i, d in collection.documents().items()} == {"1": "indexed", "2": "pending"}
    current = changelog.current_documents(spark, collection.root)
    emitted = changelog.emit_backfill(
        current, collection.root, "1", F.lit(START + dt.timedelta(hours=1))
    )
    assert [r.document_id for r in emitted.collect()] == ["2"]
    collection.embed(picky, fail_exhausted=True)
    assert collection.documents()["2"]["status"] == "failed"


def test_backfill_reaches_documents_of_a_snapshot(spark, collection, tmp_path):
    collection.send(request("1", "old"), request("2", "old, too"))
    collection.ingest()
    stored = str(tmp_path / "snapshot")
    changelog.current_documents(spark, collection.root).write.parquet(stored)
    snapshot, late = spark.read.parquet(stored), F.lit(START + dt.timedelta(hours=1))
    (tmp_path / "anew").mkdir()
    anew = Collection(spark, tmp_path / "anew")

    def current():
        return changelog.current_documents(spark, anew.root, snapshot)

    empty = changelog.emit_backfill(current(), anew.root + "-empty", "1", late)
    assert sorted(r.document_id for r in empty.collect()) == ["1", "2"]
    anew.send(request("2", "new", minute=1), request("3", "later", minute=1))
    anew.ingest()
    emitted = changelog.emit_backfill(current(), anew.root, "1", late).collect()
    assert {r.document_id: r.change_batch is None for r in emitted} == {"1": True, "2": False, "3": False}
    anew.embed(snapshot=snapshot)
    assert {r.id: (r.text, r.status) for r in current().collect()} == {
        "1": ("old", "indexed"), "2": ("new", "indexed"), "3": ("later", "indexed")
    }


def test_other_tenants_writes_are_set_aside(spark, collection):
    collection.send(request("1", "mine"), request("1", "theirs", tenant="b", minute=1))
    collection.ingest()
    assert collection.documents()["1"]["text"] == "mine"
    refused = changelog.contested_changes(spark, collection.root).collect()
    assert [(r.tenant_id, r.reject_reason) for r in refused] == [("b", "tenant_mismatch")]


def test_stream_dedup_equals_batch_dedup(spark, tmp_path, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") * 10).cast("string").alias("document_id"), F.col("ts").cast("timestamp")
    )
    # Four files in time order, as four micro-batches.
    part = F.ntile(4).over(Window.orderBy("ts"))
    numbered = log.withColumn("part", part)
    for n in range(1, 5):
        rows = numbered.filter(F.col("part") == n).drop("part").coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    kept = dedup_stream(stream, "document_id", "5 days")
    kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in dedup_jobs(log, window="5 days").collect())
    assert got == want and len(got) < log.count()


def test_superseded_jobs_cost_no_call(spark, collection, tmp_path):
    class Counting(HashEmbedder):
        """A hash embedder that notes every text it is paid for in a file."""

        def __init__(self, path):
            super().__init__(16)
            self.path = path

        def __call__(self, texts):
            with open(self.path, "a") as out:
                out.writelines(f"{t}\n" for t in texts)
            return super().__call__(texts)

    collection.send(request("1", "first text"), request("2", "gone soon"), request("3", "stays"))
    collection.ingest()
    collection.send(request("1", "second text", minute=5), request("3", "taken by b", tenant="b", minute=5))
    collection.ingest()
    at = START + dt.timedelta(minutes=6)
    changelog.delete_batch(
        spark.createDataFrame([("2", "a", at)], "document_id string, tenant_id string, ts timestamp"),
        collection.root,
        0,
    )
    calls = tmp_path / "calls.txt"
    collection.embed(Counting(str(calls)))
    assert sorted(calls.read_text().splitlines()) == ["second text", "stays"]
    docs = collection.documents()
    assert set(docs) == {"1", "3"} and {d["status"] for d in docs.values()} == {"indexed"}
    assert docs["1"]["text"] == "second text"


@pytest.mark.parametrize("window", ["0 seconds", "-5 minutes"])
def test_stream_dedup_refuses_a_window_of_no_length(spark, window):
    jobs = spark.createDataFrame([("a", START)], "document_id string, ts timestamp")
    with pytest.raises(ValueError, match="longer than nothing"):
        dedup_stream(jobs, "document_id", window)
