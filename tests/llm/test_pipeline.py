"""The pipeline's stages, each on its own input, and as a whole."""

import random

import corpus_pipeline
from docfathom.llm import cuckoo, neardup
from odd_rows import ODD


def rows_of(rng):
    def text(n):
        return " ".join(rng.choice("the and of with from this that over under near".split()) + str(rng.randrange(999)) for _ in range(n))

    plain = [text(60) for _ in range(12)]
    near = [plain[0] + " indeed", plain[1].replace(" ", "  ", 3)]
    return [*plain, *near, "mail me: bob.42@mail8.example.com " + text(30), "12 34 ...", "", None]


def test_each_stage_takes_effect(spark, make, tmp_path):
    docs = make(list(enumerate(rows_of(random.Random(1)))))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
        if i < 4:
            assert seen[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in d.select("doc_id").distinct().collect()) for d in seen]
    assert ids[0] == list(range(18))
    assert ids[1] == list(range(15))  # no letter in the last three
    assert ids[2] == [i for i in range(15) if i != 1]  # 13 is 1 with more spaces
    assert ids[3] == [i for i in range(15) if i not in (1, 12)]
    assert ids[4] == ids[5] == ids[3]
    hidden = {r.doc_id: r.text for r in seen[4].collect()}
    kept = {r.doc_id: r.text for r in seen[3].collect()}
    assert "bob.42" in kept[14] and "bob.42" not in hidden.pop(14)
    assert all(hidden[i] == kept[i] for i in hidden)
    packed = seen[5].groupBy("doc_id").sum("length").collect()
    assert len(packed) == len(ids[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted(
        (r.doc_id, r.start, r.ids_crc32) for r in seen[5].collect()
    )


def test_odd_and_empty_input(spark, make, tmp_path):
    for name, rows in (("odd", ODD), ("none", [])):
        make(rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert (len(got) > 0) == (name == "odd")


def test_stages_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, sf_dir)
    assert known.count() == docs.filter("text rlike '\\\\p{L}'").count()
    exact = {r.doc_id for r in stages["exact_dedup"](spark, docs, sf_dir).collect()}
    assert exact == {r.doc_id for r in cuckoo.dedup(docs).collect() if r.kept}
    near = {r.doc_id for r in stages["near_dedup"](spark, docs, sf_dir).collect()}
    assert near == {r.doc_id for r in neardup.near_duplicates(docs).collect() if r.kept}
