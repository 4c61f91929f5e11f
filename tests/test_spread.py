import pytest
from pyspark.sql import functions as F

from docfathom.operators.similarity import search_topk_batch
from docfathom.operators.spread import latest_per_key, lookup_join
from docfathom.sources.documents import write_documents
from test_similarity import asked, docs


@pytest.fixture
def rows(spark):
    """A key with a third of all rows, and one that no lookup has."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 100 == 1, "lost")
        .otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"),
        F.col("id").alias("seq"),
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_equals_a_plain_join(spark, rows, how):
    lookup = rows.filter("key <> 'lost'").groupBy("key").agg(F.max("seq").alias("top"))
    want = sorted(tuple(r) for r in rows.join(lookup, "key", how).collect())
    got = lookup_join(rows, lookup, ["key"], F.col("seq"), how).select("key", "seq", "top")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_lookup_join_spreads_a_hot_key(spark, rows):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    lookup = rows.groupBy("key").agg(F.max("seq").alias("top"))
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = lookup_join(rows, lookup, ["key"], F.col("seq"))
        per_task = (
            joined.filter("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 900


def test_latest_per_key(spark, rows):
    got = {r.key: r.seq for r in latest_per_key(rows, ["key"]).collect()}
    want = {r.key: r.top for r in rows.groupBy("key").agg(F.max("seq").alias("top")).collect()}
    assert got == want


def test_a_large_tenant_spans_files(spark, tmp_path):
    corpus = docs(spark, [(f"d{n:04}", "big" if n % 3 else f"t{n}", [1.0, float(n)]) for n in range(600)])
    path = str(tmp_path / "snapshot")
    write_documents(corpus, path, files=6)
    stored = spark.read.parquet(path)
    files = stored.filter("tenant_id = 'big'").select(F.input_file_name()).distinct().count()
    assert files >= 3 and stored.count() == 600


def test_a_query_without_a_vector_finds_nothing(spark):
    corpus = docs(spark, [("x", "a", [1.0, 0])])
    found = search_topk_batch(corpus, asked(spark, [("none", "a", None, 5), ("q", "a", [1.0, 0], 5)]))
    assert [r.query_id for r in found.collect()] == ["q"]
