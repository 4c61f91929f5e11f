"""The source divergence audit against a plain Python count of the same rules."""

import random
from collections import Counter

from docfathom.llm import divergence
from odd_rows import ODD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, p long"


def brute(rows):
    """Dense p of every kept term in every group and language, then both parts."""
    docs = [((lang or ""), (source or ""), divergence.terms(text)) for text, lang, source in rows]
    langs = sorted({d[0] for d in docs})
    groups = sorted({(d[0], d[1]) for d in docs})
    out = []
    for lang in langs:
        df = Counter(t for l, _, ts in docs if l == lang for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= divergence.MIN_DOCS)
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 5)) // (n + 5 * v) for t in kept}

        whole = shares(Counter(t for l, _, ts in docs if l == lang for t in ts))
        mine = [g for g in groups if g[0] == lang]
        counts = {g: Counter(t for l, s, ts in docs if (l, s) == g for t in ts) for g in mine}
        p = {g: shares(counts[g]) for g in mine}
        for g in mine:
            pair = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in mine if h != g]
            term = [(p[g][t] - whole[t], t) for t in kept if counts[g][t] > 0 and p[g][t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, divergence.TOP_TERMS)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(items[:most], 1):
                    out.append((lang, g[1], part, item, value, rank))
    return sorted(out)


def corpus(seed=7, n=160):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "délta", "ëpsilon", "zeta", "ETA", "theta", "iota", "kappa", "lambda", "mu"]
    rows = []
    for i in range(n):
        lang = ["en", "fr", None][i % 3]
        source = ["s1", "s2", "s3", None, "s1"][i % 5]
        k = rng.randint(0, 30)
        text = " ".join(rng.choice(words[: 4 + i % 8]) for _ in range(k)) + rng.choice(["", " 42x9!", " mu-mu"])
        rows.append((i, text, lang, source))
    rows += [(None if i is None else i + 1000, t, "en", "s9") for i, t in ODD]
    rows += [(2000, None, None, None), (2001, "Alpha beta", "de", "only")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, l, s, 0, "clash", 1) for i, t, l, s in rows], SCHEMA
    ).repartition(5)


def collect(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_audit_equals_counting(spark):
    rows = corpus()
    want = brute([(t, l, s) for _, t, l, s in rows])
    assert any(r[2] == "term" for r in want) and any(r[2] == "pair" and r[4] > 0 for r in want)
    got = divergence.audit(table(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert collect(got) == want


def test_small_blocks_spill_and_merge(spark):
    rows = corpus(seed=3)
    assert collect(divergence.audit(table(spark, rows), limit=7)) == brute([(t, l, s) for _, t, l, s in rows])


def test_no_kept_terms_and_empty(spark):
    rows = [(1, "x y", "en", "a"), (2, None, "en", "b"), (3, "", None, None)]
    got = collect(divergence.audit(table(spark, rows)))
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(table(spark, []).limit(0)).count() == 0


def test_hot_term_ties(spark):
    rows = [(i, "same same words here", "en", f"s{i % 4}") for i in range(200)]
    got = collect(divergence.audit(table(spark, rows)))
    assert got == brute([(t, l, s) for _, t, l, s in rows])
    assert all(r[4] == 0 for r in got if r[2] == "pair")
