"""The cuckoo-filter index, and exact and near duplicates, against plain Python."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from docfathom.llm import cuckoo, neardup
from docfathom.llm.queries import QUERIES
from odd_rows import ODD

SPACE = " \t\n\x0b\x0c\r"


def bare(text):
    return "".join(c for c in text or "" if c not in SPACE)


def test_cuckoo_shard_inserts_grows_and_deletes():
    shard = cuckoo.CuckooShard(4)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for d in digests:
        assert shard.find(d, 1) is None
        shard.insert(d, 1, 1)
    assert shard.n_buckets > 4 and all(shard.find(d, 1)[2] == 1 for d in digests)
    shard.insert(digests[0], 1, 2)
    assert shard.delete(digests[0], 1, 2) and shard.find(digests[0], 1)
    for d in digests[::2]:
        assert shard.delete(d, 1, 1)
    assert not shard.delete(digests[0], 1, 1)
    assert all((shard.find(d, 1) is None) == (i % 2 == 0) for i, d in enumerate(digests))
    assert shard.n_keys == 1500


def test_equal_fingerprints_are_told_apart_by_content():
    shard = cuckoo.CuckooShard(4)
    a, b = (bytes(8) + bytes([1, 2]) + bytes(8) + bytes([i]) * 14 for i in (1, 2))
    shard.insert(a, 1, 1)
    assert shard.may_hold(b) and shard.find(b, 1) is None
    shard.insert(b, 1, 1)
    assert shard.delete(a, 1, 1) and shard.find(b, 1) and shard.find(a, 1) is None


def test_exact_groups_of_odd_rows(odd, make):
    rows = cuckoo.dedup(odd).collect()
    assert len(rows) == len(ODD)
    want = {}
    for i, t in ODD:
        want.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    for r in rows:
        group = want[next(b for b in want if hashlib.sha256(b.encode()).hexdigest() == r.text_sha256)]
        assert (r.keep_id, r.group_size) == (min(group)[3], len(group))
        assert r.kept == (r.doc_id == r.keep_id)
    assert cuckoo.dedup(make([])).count() == 0
    kept = cuckoo.keep_distinct(odd)
    assert kept.columns == odd.columns
    # 6 has most code points of the empty texts, 4 of the two of alpha; 7 repeats itself.
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 5, 6, 7, 7, 8]


def test_index_changes(spark):
    def rows(*values):
        out = [(op, hashlib.sha256(k.encode()).digest(), 1, n) for op, k, n in values]
        return spark.createDataFrame(out, "op string, digest binary, n_bytes long, copies long")

    index = rows((None, "a", 2), (None, "b", 1))
    changes = rows(("delete", "b", 1), ("insert", "a", 1), ("insert", "c", 1), ("delete", "d", 1))
    got = cuckoo.change_index(index, changes, 4).collect()
    name = {hashlib.sha256(k.encode()).digest(): k for k in "abcd"}
    live = {name[bytes(r.digest)]: r.copies for r in got if r.op is None}
    found = {(r.op, name[bytes(r.digest)]): r.found for r in got if r.op}
    assert live == {"a": 3, "c": 1}
    assert found == {("delete", "b"): True, ("insert", "a"): True, ("insert", "c"): False, ("delete", "d"): False}


def brute(rows, words):
    """(set size, component) of each id, all pairs compared."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            one, two = root(a), root(b)
            top[max(one, two)] = min(one, two)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def families():
    """Chains of edits, a star of near copies, passages in common, and strangers."""
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**5)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 3, 9])):
            texts.append(" ".join(words))
            words = edited(rng, words, max(1, len(words) // 60))
    base = [f"s{rng.randrange(10**5)}" for _ in range(200)]
    texts += [" ".join(edited(rng, base, rng.choice([1, 2, 4, 6]))) for _ in range(150)]
    passage = [f"p{rng.randrange(10**5)}" for _ in range(80)]
    texts += [" ".join([*passage, *(f"q{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(30)]
    texts += [texts[5], texts[5].upper(), "one two", "one  two", "one two three", "", None]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [4, 5])
def test_components_equal_all_pairs(families, make, words):
    got = neardup.near_duplicates(make(families), words=words).collect()
    want = brute(families, words)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_in_small_tiles(families, make, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", 4)
    monkeypatch.setattr(neardup, "TILE_SHINGLES", 500)
    got = neardup.near_duplicates(make(families), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(families, 4)


def test_given_documents_equal_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op10_minhash_bayes"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4)


def test_near_duplicates_of_odd_rows(odd, make):
    got = neardup.near_duplicates(odd, words=4).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.component_id == {4: 1}.get(r.doc_id, r.doc_id)
        assert r.kept == (r.doc_id != 4)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id} == {1: 7, 2: 0, 3: 0, 4: 7, 5: 1, 6: 0, 7: 1, 8: 1}
    kept = neardup.keep_one_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert neardup.near_duplicates(make([])).count() == 0


def test_pruning_keeps_what_may_be_similar():
    table = neardup.least_matches(0.8, 1e-7, 140)
    assert [n for n, _ in table] == [28, 56, 84, 112, 140]
    one = np.arange(140, dtype=np.uint32)
    near, far = one.copy(), one.copy()
    near[::5] += 1000  # four of five hashes match
    far[::2] += 1000
    assert neardup.survives(one, np.array([near, far, one]), 0.8, 1e-7).tolist() == [0, 2]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300)], "a long, b long")
    got = {r.node: r.component for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}
    assert neardup.components(links.limit(0)).count() == 0


def test_components_of_few_edges_are_written_by_few_tasks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (7, 7)], "a long, b long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = neardup.components(links)
        assert found.rdd.getNumPartitions() <= 2
        rows = {(r.node, r.component) for r in found.collect()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert rows == {(i, 0) for i in range(1, 41)} | {(91, 90)}
    assert neardup.components(links.limit(0)).count() == 0


@pytest.fixture
def written(monkeypatch):
    """The tables that a run writes."""
    found, real = [], neardup.materialize

    def watched(rows):
        found.append(real(rows))
        return found[-1]

    monkeypatch.setattr(neardup, "materialize", watched)
    return found


def test_steps_of_few_rows_are_written_by_few_tasks(spark, families, make, written):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = neardup.near_duplicates(make(families[:60]), words=4)
        counts = [rows.rdd.getNumPartitions() for rows in written]
        rows = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert max(counts[1:]) <= 16, counts
    assert rows == brute(families[:60], 4)


def test_pairs_of_many_groups_are_confirmed_once(families, make, written, monkeypatch):
    # Without leaders every pair is left to the tiles.
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(neardup, "TILE_ROWS", 8)
    monkeypatch.setattr(
        neardup.Similar, "leaders_of", lambda self, members: members.select("node", "leader").filter("false")
    )
    got = neardup.near_duplicates(make(families), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(families, 4)
    (near,) = (rows for rows in written if "mates" in rows.columns)
    nodes, marked = {}, []
    for r in near.collect():
        nodes[r.bucket, r.i, r.j, r.place] = r.node
        places = np.flatnonzero(np.unpackbits(np.frombuffer(r.mates, np.uint8))).tolist()
        marked += [(r.node, (r.bucket, r.i, r.j, place)) for place in places]
    pairs = [frozenset((node, nodes[mate])) for node, mate in marked]
    assert len(pairs) > 100 and len(set(pairs)) == len(pairs)


def test_links_across_components_are_found_once(spark, make, monkeypatch):
    seen, real = [], neardup.components

    def watched(links):
        seen.append(links._jdf.queryExecution().optimizedPlan().toString())
        return real(links)

    monkeypatch.setattr(neardup, "components", watched)
    docs = make([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y")])
    rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert rows == {1: 1, 2: 1, 3: 3}
    assert len(seen) == 3 and not any("MapInArrow" in plan for plan in seen)
