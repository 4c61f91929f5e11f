"""Whitening against exact moments and numpy's symmetric eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from docfathom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(4)


def exact_fit(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(sum((r[i] * n - s[i]) * (r[j] * n - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return x, s, cov, values[order], vectors_[:, order].T


def check(got, vectors, ids):
    x, s, cov, values, comps = exact_fit(vectors)
    n = len(x)
    k = min(whitening.COMPONENTS, int((values > 1e-9 * values[0]).sum()))
    assert {r.component for r in got} == set(range(1, k + 1))
    assert len(got) == len(ids) * k
    trace = float(np.trace(cov))
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for i, vid in enumerate(ids):
        dev = sum((xv * n - sv) ** 2 for xv, sv in zip(x[i], s))
        for c in range(1, k + 1):
            r = by_row[vid][c]
            assert r.n == n and r.deviation == dev
            assert abs(r.explained - values[c - 1] / trace) <= 1e-4 * values[c - 1] / trace
            want = (np.array(x[i], float) - np.array(s, float) / n) @ comps[c - 1] / math.sqrt(values[c - 1])
            sign = signs.setdefault(c, 1.0 if want * r.whitened >= 0 else -1.0)
            assert abs(sign * r.whitened - want) <= 1e-6 * (1 + abs(want))
            assert 0 <= r.identity_error <= 1e-4


def test_whitening_equals_eigh(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    got = whitening.whiten(frame(spark, rows)).collect()
    check(got, [v for _, v in rows], [i for i, _ in rows])


def test_dropped_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = [(i, [float(c) for c in rng.normal(size=4) * 3]) for i in range(60)]
    good.append((60, [1e30, 2.0, -3.0, 4.0]))
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan"), 1.0, 1.0, 1.0]),
           (103, [float("inf"), 1.0, 1.0, 1.0]), (104, [])]
    got = whitening.whiten(frame(spark, good + bad)).collect()
    assert not {r.vec_id for r in got} & {100, 101, 102, 103, 104}
    big = [r for r in got if r.vec_id == 60]
    assert big and all(r.deviation is None for r in big)  # beyond a long, stated as null


def test_rank_deficient_and_repeats(spark):
    rows = [(i % 5, [float(i), float(2 * i), 1.0]) for i in range(40)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1}
    assert len(got) == 40
    assert got[0].explained == pytest.approx(1.0, rel=1e-9)


def test_empty_and_single(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
