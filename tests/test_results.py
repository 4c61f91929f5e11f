import datetime as dt
import json

from pyspark.sql import functions as F

from docfathom.functions import documents as fn
from docfathom.operators import monitor, results
from docfathom.operators.similarity import search_topk_batch
from test_similarity import NOW, asked, docs


def keyed(spark, rows):
    return results.with_cache_key(asked(spark, rows), "m")


def test_fresh_results_are_reused(spark):
    corpus = docs(spark, [("x", "a", [1.0, 0]), ("y", "a", [0, 1.0])])
    queries = keyed(spark, [("hit", "a", [1.0, 0], 2), ("old", "a", [0, 1.0], 2), ("none", "b", [1.0, 0], 2)])
    hits = search_topk_batch(corpus, queries)
    age = F.when(F.col("query_id") == "old", 120).otherwise(119)
    cache = results.cache_entries(queries, hits, F.lit(NOW) - F.make_dt_interval(secs=age))
    # The collection changed since: reused results still show the earlier state.
    later = docs(spark, [("z", "a", [1.0, 1.0]), ("w", "b", [1.0, 0])])
    found = results.cached_search(later, queries, cache, F.lit(NOW))
    got = {(r.query_id, r.id, r.from_cache) for r in found.collect()}
    # An empty list of results is a result too.
    assert got == {("hit", "x", True), ("hit", "y", True), ("old", "z", False)}
    left = results.invalidate_tenants(cache, spark.createDataFrame([("a",), ("a",)], "tenant_id string"))
    assert [r.tenant_id for r in left.collect()] == ["b"]


def test_key_depends_on_everything_the_answer_does(spark):
    base = ("q", "a", [0.25, 0.5], 10)
    rows = [base, ("q", "b", *base[2:]), ("q", "a", [0.25, 0.500002], 10), ("q", "a", [0.25, 0.5], 11)]
    keys = [r.cache_key for r in keyed(spark, rows).collect()]
    keys += [results.with_cache_key(asked(spark, [base]), "other").first().cache_key]
    assert len(set(keys)) == 5 and keys[0].startswith("search:a:")
    # Asked limits that mean the same share a key.
    same = keyed(spark, [("q", "a", [0.25, 0.5], 0), base]).collect()
    assert same[0].cache_key == same[1].cache_key


def test_response(spark):
    corpus = docs(spark, [("x", "a", [1.0, 0]), ("y", "a", [1.0, 1.0])])
    corpus = corpus.withColumn("metadata", F.create_map(F.lit("b"), F.lit('"q"'), F.lit("a"), F.lit("é")))
    hits = search_topk_batch(corpus, asked(spark, [("q", "a", [1.0, 0], 5)]))
    response = json.loads(results.search_responses(hits, corpus).first().response)
    assert [r["document_id"] for r in response["results"]] == ["x", "y"]
    assert response["results"][1] == {
        "document_id": "y", "text": "text of y", "metadata": {"a": "é", "b": '"q"'}, "similarity": 0.707107,
    }


def test_counts_include_queries_without_results(spark):
    queries = asked(spark, [("q", "a", [1.0], 5), ("r", "b", [1.0], 5)])
    hits = search_topk_batch(docs(spark, [("x", "a", [1.0])]), queries)
    assert {(r.query_id, r.n_results) for r in results.search_result_counts(queries, hits).collect()} == {
        ("q", 1), ("r", 0),
    }


def test_metadata_round_trip(spark):
    maps = [{}, {"k": 'quote " and \\ and \n', "a": "é€"}, None]
    frame = spark.createDataFrame([(m,) for m in maps], "m map<string,string>")
    text = frame.select(fn.metadata_to_json(F.col("m")).alias("j"))
    assert [r.j for r in text.collect()][0] == "{}"
    back = text.select(fn.metadata_from_json(F.col("j")).alias("m")).collect()
    assert [r.m for r in back] == [{}, maps[1], {}]


def test_backlog_needs_consecutive_buckets(spark):
    rows = []
    for minute, net in enumerate([600, 0, 0, 0, 0, -200, 300]):
        rows += [(NOW + dt.timedelta(minutes=minute), net)]
    frame = spark.createDataFrame(rows, "ts timestamp, change int")
    found = monitor.signal_backlog(frame).orderBy("window_start").collect()
    assert [r.alert for r in found] == [False] * 4 + [True, False, False]


def test_backfill_summary(spark):
    corpus = docs(spark, [("p", "a", None), ("i", "a", [1.0])])
    as_of = F.lit(NOW + dt.timedelta(minutes=31))
    row = monitor.backfill_summary(corpus, as_of, dry_run=True).first()
    assert (row.cutoff, row.total_pending, row.queued, row.dry_run) == ("2024-01-01T00:01:00Z", 1, 0, True)
    assert monitor.count_pending(corpus, as_of, "32 minutes").first().n_pending == 0
    assert monitor.signal_stale_pending(corpus, as_of).first().alert
