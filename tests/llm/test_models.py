"""Nearest neighbours against brute force; the quality model by held-out labels."""

import math
import os
import zlib

import numpy as np
import pytest

from docfathom.llm import blockjoin, quality
from docfathom.llm.queries import QUERIES
from odd_rows import ODD
from pyspark.sql import functions as F


def brute(rows, asks, k):
    """(query, rank) -> (id, score) over usable rows, in double precision."""
    good = [
        (i, np.array(v, float))
        for i, v in rows
        if i is not None
        and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
        and any(v)
    ]
    out = []
    for i, q in good:
        if asks(i):
            near = sorted((-float((q * v).sum()), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def check(got, want):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op5_block_join"](spark, sf_dir).collect(), brute(rows, lambda i: i % 20 == 0, 20))


@pytest.mark.parametrize("block", [16, 4096])
def test_ties_copies_scales_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(blockjoin, "BLOCK", block)
    monkeypatch.setattr(blockjoin, "QUERY_BLOCK", max(2, block // 8))
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0] * 8) for i in range(60)]
    rows += [(300, None), (301, [0.0] * 8), (302, [None] + [1.0] * 7), (303, [float("nan")] * 8)]
    rows += [(304, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (310, [1.0, 2.0]), (315, [3.0, -1.0]), (320, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = blockjoin.nearest(frame, F.col("vec_id") % 5 == 0, k=20).collect()
    check(got, brute(rows, lambda i: i % 5 == 0, 20))
    none = frame.limit(0)
    assert blockjoin.nearest(none, F.col("vec_id") % 5 == 0, k=20).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(40, 16)), rng.normal(size=(50, 16)) * 100
    qa, sa, la, ea = blockjoin.quantized(a)
    qb, sb, lb, eb = blockjoin.quantized(b)
    near = blockjoin._int8_product(qa, qb) * (sa[:, None] * sb)
    assert qa.dtype == np.int8
    assert (np.abs(near - a @ b.T) <= ea[:, None] * (lb + eb) + la[:, None] * eb + 1e-9).all()


def test_held_out_quality(spark, sf_dir):
    # The smallest tables have 19 such rows, too few to tell.
    sf_dir = f"{os.path.dirname(sf_dir.rstrip('/'))}/sf0.01"
    rows = QUERIES["op9_quality"](spark, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in unseen) / len(unseen) >= 0.9


def test_word_vectors_are_sums_of_neighbours(make):
    texts = ["a b c a b", "c c a", None, "b " * 9000]
    known, want = quality.Buckets(), np.zeros((quality.BUCKETS, quality.DIMS))
    index = quality.index_vectors()
    for t in texts:
        found = [known[w.encode()] for w in (t or "").split()]
        for i, w in enumerate(found):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(found):
                    want[w] += index[found[j]]
    got = quality.word_vectors(make(list(enumerate(texts))))
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.maximum(norm, 1e-9), atol=1e-5)


def test_temperature_lowers_the_loss_of_unseen_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, quality.WIDTH)).astype(np.float32)
    y = (rng.random(2000) < quality.probability(x[:, 0])).astype(int)
    model = quality.train(np.zeros((1, 1)), x, y)
    fresh = rng.normal(size=(4000, quality.WIDTH))
    truth = (rng.random(4000) < quality.probability(fresh[:, 0])).astype(int)
    logits = model.logits(fresh)
    assert quality.log_loss(logits / model.temperature, truth) < quality.log_loss(logits, truth)


def test_quality_of_odd_rows(spark, make, odd):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (5, 0), (8, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    unlabelled = quality.fit(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, unlabelled).collect()} == {0.5}
    none = make([])
    assert quality.score(none, quality.fit(none, labels)).count() == 0
