"""Near-duplicates by MinHash bands and sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (64-bit hashes), a
   128-bit digest of that set and a MinHash signature. Equal sets are one class.
2. Signatures are cut into bands; classes that share a band's value are candidates.
   A band's group is not expanded into pairs. Each class is first compared with
   one leader, the smallest class of most of its groups.
3. Comparing goes batch by batch of hashes. With a uniform prior, m matches of n
   hashes give similarity a Beta(m+1, n-m+1) posterior; a pair is dropped as soon
   as its chance of reaching the threshold is below the miss probability.
4. Survivors are confirmed on their full sets, and links joined to components. In
   each further round two components that share a group are compared by one pair.
5. Groups whose members are still in several components are compared across
   components, in tiles of bounded size, in the same two steps. A pair counts in the
   first band that it shares, so it is confirmed once, however many groups it is in.
   So every candidate pair has been compared or is connected otherwise, and a huge
   group of near copies costs a comparison a member, not one a pair.

Every step is dealt to as many tasks as its rows need, which are known from the step
before: with many shuffle partitions, tasks without rows would take most of the time.

Chance that a pair at the threshold 0.8 shares no band: (1 - 0.8^5)^28 < 2e-5; that
it is pruned: below 5 x ``miss``. Different shingles have equal hashes in less than
one of 1e10 comparisons of texts with 10,000 words.

Null text is empty. Texts without words have no shingles and no links. Repeated
rows get equal answers. Different texts under one ``doc_id`` each follow their own
links; where that id is the smallest of both, the id connects them. Rows without an
id take no part: their component is null and they are kept. An empty table gives no
rows.
"""

from __future__ import annotations

import functools
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docfathom.llm.text import mix64, raw_texts
from docfathom.operators.spread import sent_if_small
from docfathom.session import materialize

WORDS = 5
BANDS = 28
ROWS = 5
#: Hashes compared before each look at the posterior.
LOOK = 28
MISS = 1e-7
#: Shingles, and signatures, that a tile is planned for on each side.
TILE_SHINGLES = 1 << 17
TILE_ROWS = 256
#: Rounds that compare components by one pair each, before tiles compare the rest.
STAR_ROUNDS = 1
#: Edges that one task of a round of components takes.
TASK_EDGES = 20_000
#: Rows, and those of a column or two, that one task of any other step takes.
TASK_ROWS, TASK_NARROW_ROWS = 5_000, 20_000
#: Low bits of a bucket, which hold its band.
BAND_BITS = 5
#: Distinct words whose hashes a worker keeps.
KNOWN_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@functools.cache
def known_words() -> WordHashes:
    return WordHashes()


def shingles(raw: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; few words are one shingle."""
    found = raw.lower().split()  # both know ASCII only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    base = np.uint64(0x9E3779B97F4A7C15)
    width = min(words, len(h))
    n = len(h) - width + 1
    rolled = np.full(n, width, np.uint64)
    for i in range(width):
        rolled *= base
        rolled += h[i : i + n]
    return np.unique(mix64(rolled))


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds[n:].astype(np.uint32)


def signature(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each of n permutations (unsigned 32-bit)."""
    factor, mask = _permutations(n)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 512):
        np.minimum(least, ((short[a : a + 512, None] ^ mask) * factor).min(axis=0), out=least)
    return least


@functools.cache
def least_matches(threshold: float, miss: float, hashes: int, look: int = LOOK) -> tuple[tuple[int, int], ...]:
    """(n, m): with fewer than m matches of the first n hashes a pair is dropped.

    P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in [*range(look, hashes, look), hashes]:
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        found.append((n, m))
    return tuple(found)


def survives(one: np.ndarray, many: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of ``many`` may be as similar to ``one`` (or its rows) as is asked."""
    alive, start = np.arange(len(many)), 0
    matches = np.zeros(len(many), np.int64)
    for n, least in least_matches(threshold, miss, many.shape[1]):
        against = one[start:n] if one.ndim == 1 else one[alive, start:n]
        matches[alive] += (many[alive, start:n] == against).sum(axis=1)
        alive, start = alive[matches[alive] >= least], n
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set) and signature of every row."""

    def run(batches):
        import xxhash

        hashes = known_words()
        for batch in batches:
            if len(hashes) > KNOWN_WORDS:
                hashes.clear()
            n, sets, signatures = [], [], []
            for raw in raw_texts(batch):
                found = shingles(raw, words, hashes)
                n.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(sets, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_id", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_id binary, signature binary"
    )


def groups_of(batches, keys: list[str]):
    """Row groups with equal keys, as dicts of lists, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []

    def joined(parts):
        return pa.Table.from_batches(parts).to_pydict()

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield last, joined(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield last, joined(held)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node: the smallest node it reaches.

    Rounds of large-star and small-star until no edge changes. Minima combine
    before they are shuffled; AQE splits the edges of a hub where they are joined.
    Each shuffle is written by as many tasks as the edges need: a round has eight,
    and files of no content would outweigh the edges.
    """

    def told_apart(edges: DataFrame):
        # Sums of halves do not overflow, however many edges there are.
        return edges.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)),
            F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 32)),
        ).first()

    links = links.toDF("a", "b")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = edges.filter("u <> v")
    edges = materialize(edges.distinct().coalesce(2 + edges.count() // TASK_EDGES))
    before = told_apart(edges)
    while True:
        tasks = 2 + before[0] // TASK_EDGES
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.coalesce(tasks).distinct().coalesce(tasks))
        now = told_apart(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def in_tasks(rows: DataFrame, count: int, each: int = TASK_NARROW_ROWS) -> DataFrame:
    """``rows``, ``count`` of them at most or about, in as many tasks as they need."""
    return rows.coalesce(2 + count // each)


def with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, node, comp): members with their component so far, at first themselves."""
    known = found.withColumnRenamed("component", "known")
    return members.select("bucket", "node").join(known, "node", "left").select(
        "bucket", "node", F.coalesce("known", "node").alias("comp")
    )


class Similar:
    """One run over ``docs``: its parameters, and the tables that its steps share."""

    def __init__(self, docs: DataFrame, words: int, percent: int, miss: float):
        self.docs, self.words, self.percent, self.miss = docs, words, percent, miss
        self.rows = materialize(profiles(docs, words))
        self.n_rows = self.rows.count()
        taking_part = self.rows.filter("doc_id is not null and set_id is not null")
        #: A class: its digest, its node (smallest id), size and signature.
        classes = taking_part.groupBy("set_id").agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature"),
        )
        self.classes = materialize(in_tasks(classes, self.n_rows, TASK_ROWS))

    def members(self) -> DataFrame:
        """(bucket, node, leader): bands' groups of two classes or more.

        A bucket is a hash of the band's value, and the band's number in its low bits.
        """
        width = 4 * ROWS

        def bucket(i):
            value = F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width)))
            return F.shiftleft(value, BAND_BITS).bitwiseOR(i.cast("long"))

        bands = self.classes.select(
            "node",
            F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), bucket)).alias("bucket"),
        )
        leaders = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
        leaders = leaders.filter("leader <> last").drop("last")
        members = materialize(in_tasks(bands.join(leaders, "bucket"), BANDS * self.n_rows))
        self.n_members = members.count()
        return in_tasks(members, self.n_members)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes, made again from their texts."""
        nodes = in_tasks(nodes.select(F.col("node").alias("wanted")).distinct(), self.n_rows)
        nodes = sent_if_small(nodes)
        wanted = self.docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(
            nodes, F.col("node") == F.col("wanted"), "left_semi"
        )
        words = self.words

        def run(batches):
            hashes = known_words()
            for batch in batches:
                if len(hashes) > KNOWN_WORDS:
                    hashes.clear()
                found = [shingles(raw, words, hashes).tobytes() for raw in raw_texts(batch)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"]
                )

        return wanted.mapInArrow(run, "node long, shingles binary")

    def leaders_of(self, members: DataFrame) -> DataFrame:
        """(node, leader): the leader of most of a node's groups."""
        # Of leaders with equally many groups the smallest; a node has a leader a band.
        found = members.filter("node <> leader").groupBy("node").agg(F.mode("leader", True).alias("leader"))
        return in_tasks(found, self.n_rows)

    def leaders_of_components(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """(node, leader): one pair for two components that share a group.

        In each group every component is stood for by its smallest node there, and
        compared with the smallest of all. Of the pairs of two components that with
        most groups counts.
        """
        own = in_tasks(with_components(members, found), self.n_members)
        stand_ins = own.groupBy("bucket", "comp").agg(F.min("node").alias("node"))
        stand_ins = materialize(in_tasks(stand_ins, self.n_members))
        first = stand_ins.groupBy("bucket").agg(
            F.count("*").alias("comps"), F.min(F.struct("node", "comp")).alias("first")
        )
        first = first.filter("comps > 1").select("bucket", "first.node", "first.comp").toDF("bucket", "leader", "led")
        pairs = in_tasks(stand_ins.join(in_tasks(first, self.n_members), "bucket"), self.n_members)
        pairs = pairs.filter("comp <> led").groupBy("comp", "led", "node", "leader").agg(F.count("*").alias("n"))
        best = in_tasks(pairs, self.n_members).groupBy("comp", "led").agg(
            F.max(F.struct("n", "node", "leader")).alias("best")
        )
        # Different components have different nodes, so no pair comes twice.
        return in_tasks(best.select("best.node", "best.leader"), self.n_members)

    def star_links(self, pairs: DataFrame, most: int) -> DataFrame:
        """Confirmed links (a, b) among pairs (node, leader), ``most`` at most."""
        signed = self.classes.select("node", "signature", "n_shingles")
        both = in_tasks(pairs.join(signed, "node"), most, TASK_ROWS).join(
            signed.select(F.col("node").alias("leader"), F.col("signature").alias("leads")), "leader"
        )
        both = in_tasks(both, most, TASK_ROWS)
        threshold, miss, percent = self.percent / 100, self.miss, self.percent

        def prune(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                one, two = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                    for c in ("signature", "leads")
                )
                yield batch.select(["node", "leader", "n_shingles"]).take(
                    pa.array(survives(one, two, threshold, miss))
                )

        near = both.mapInArrow(prune, "node long, leader long, n_shingles long").distinct()
        near = materialize(in_tasks(near, most))
        n_near, n_shingles = near.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
        # A leader's set meets its members' in as many tiles as they have shingles for.
        tiles = near.groupBy("leader").agg(
            F.ceil(F.sum("n_shingles") / TILE_SHINGLES).cast("int").alias("tiles")
        )
        tiles = in_tasks(tiles, n_near)
        of_members = in_tasks(near.join(tiles, "leader"), n_near).select(
            "leader", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "node"
        )
        of_leaders = tiles.select(
            "leader",
            F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"),
            F.col("leader").alias("node"),
        )
        wanted = materialize(of_members.union(of_leaders))
        rows = in_tasks(wanted.join(self.sets(wanted), "node"), n_shingles, TILE_SHINGLES)

        def confirm(batches):
            for (leader, _), group in groups_of(batches, ["leader", "tile"]):
                sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
                leads = [s for n, s in zip(group["node"], sets) if n == leader]
                found = [
                    n
                    for n, s in zip(group["node"], sets)
                    if n != leader and any(linked(s, x, percent) for x in leads)
                ]
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(found), "b": pa.array([leader] * len(found))})

        keys = ["leader", "tile"]
        rows = in_tasks(rows.repartition(*keys), n_shingles, TILE_SHINGLES).sortWithinPartitions(*keys)
        return rows.mapInArrow(confirm, "a long, b long")

    def cross_links(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Confirmed links between components that share a group."""
        own = materialize(in_tasks(with_components(members, found), self.n_members))
        counts = in_tasks(own.groupBy("bucket", "comp").agg(F.count("*").alias("n")), self.n_members)
        # The largest component of a group, and how many rows are outside it.
        split = (
            counts.groupBy("bucket")
            .agg(F.count("*").alias("comps"), F.sum("n").alias("rows"), F.max(F.struct("n", "comp")).alias("main"))
            .filter("comps > 1")
            .select("bucket", F.col("main.comp").alias("main"), "rows", (F.col("rows") - F.col("main.n")).alias("out"))
        )
        split = in_tasks(split, self.n_members)
        # Chunks of outliers first, then of the main component; one chunk if all fit.
        out = F.when(F.col("rows") <= TILE_ROWS, 1).otherwise(F.ceil(F.col("out") / TILE_ROWS)).cast("int")
        main = F.when(F.col("rows") <= TILE_ROWS, 0).otherwise(
            F.ceil((F.col("rows") - F.col("out")) / TILE_ROWS)
        ).cast("int")
        open_rows = (
            in_tasks(own.join(split, "bucket"), self.n_members)
            .withColumns({"n_out": out, "n_main": main, "is_main": F.col("comp") == F.col("main")})
            .withColumn(
                "chunk",
                F.when(
                    F.col("is_main") & (F.col("n_main") > 0),
                    F.col("n_out") + F.pmod(F.xxhash64("node"), F.greatest("n_main", F.lit(1))),
                )
                .otherwise(F.pmod(F.xxhash64("node"), F.col("n_out")))
                .cast("int"),
            )
        )
        # Tiles (i, j): chunk i holds outliers, i <= j.
        all_chunks = F.sequence(F.lit(0), F.col("n_out") + F.col("n_main") - 1)
        tiles = F.when(
            F.col("chunk") < F.col("n_out"),
            F.transform(all_chunks, lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j"))),
        ).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.col("n_out") - 1),
                lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j")),
            )
        )
        tiled = open_rows.select("bucket", F.explode(tiles).alias("t"), "chunk", "node", "comp").select(
            "bucket", "t.i", "t.j", "chunk", "node", "comp"
        )
        tiled = materialize(tiled)
        n_tiled = tiled.count()
        keys, threshold, miss, percent = ["bucket", "i", "j"], self.percent / 100, self.miss, self.percent

        def prune(batches):
            for key, group in groups_of(batches, keys):
                comp, chunk = np.array(group["comp"]), np.array(group["chunk"])
                band = key[0] & (1 << BAND_BITS) - 1
                signatures = np.frombuffer(b"".join(group["signature"]), np.uint32).reshape(len(comp), -1)
                bands = signatures.reshape(len(comp), -1, ROWS)[:, : band + 1]
                pairs = np.zeros((len(comp), len(comp)), bool)
                for i in range(len(comp) - 1):
                    # Pairs of one chunk meet in its own tile.
                    met = comp[i + 1 :] != comp[i]
                    others = i + 1 + np.flatnonzero(met if key[1] == key[2] else met & (chunk[i + 1 :] != chunk[i]))
                    alive = others[survives(signatures[i], signatures[others], threshold, miss)]
                    shared = (bands[alive] == bands[i]).all(axis=2)
                    pairs[i, alive[shared[:, band] & ~shared[:, :band].any(axis=1)]] = True
                at = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
                if len(at):
                    mates = np.packbits(pairs[at][:, at], axis=1)
                    yield pa.RecordBatch.from_pydict(
                        {k: pa.array([v] * len(at), pa.int64()) for k, v in zip(keys, key)}
                        | {"place": pa.array(range(len(at)), pa.int32())}
                        | {"node": np.array(group["node"])[at], "comp": comp[at]}
                        | {"mates": pa.array([m.tobytes() for m in mates], pa.binary())}
                    )

        signed = in_tasks(tiled.join(self.classes.select("node", "signature"), "node"), n_tiled, TASK_ROWS)
        near = in_tasks(signed.repartition(*keys), n_tiled, TASK_ROWS).sortWithinPartitions(*keys)
        near = materialize(
            near.mapInArrow(prune, "bucket long, i long, j long, place int, node long, comp long, mates binary")
        )

        def confirm(batches):
            for _, group in groups_of(batches, keys):
                comp, sets = group["comp"], [np.frombuffer(s, np.uint64) for s in group["shingles"]]
                top = {c: c for c in comp}
                at_place: dict[int, list[int]] = {}  # several rows where an id is repeated
                for i, place in enumerate(group["place"]):
                    at_place.setdefault(place, []).append(i)

                def root(c):
                    while top[c] != c:
                        c = top[c]
                    return c

                a, b = [], []
                for i, mates in enumerate(group["mates"]):
                    places = np.flatnonzero(np.unpackbits(np.frombuffer(mates, np.uint8)))
                    for j in (j for place in places.tolist() for j in at_place[place]):
                        one, two = root(comp[i]), root(comp[j])
                        if one != two and linked(sets[i], sets[j], percent):
                            top[one] = two
                            a.append(group["node"][i])
                            b.append(group["node"][j])
                if a:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

        n_near = near.count()
        rows = in_tasks(near.join(self.sets(near), "node"), n_near, TILE_ROWS)
        rows = in_tasks(rows.repartition(*keys), n_near, TILE_ROWS).sortWithinPartitions(*keys)
        return rows.mapInArrow(confirm, "a long, b long")

    def result(self) -> DataFrame:
        members = self.members()
        # Links are written once: finding components goes over them several times.
        # Those of the rounds before are stood for by what each node reaches.
        found = components(materialize(self.star_links(self.leaders_of(members), self.n_rows)))
        for _ in range(STAR_ROUNDS):
            links = self.star_links(self.leaders_of_components(members, found), self.n_members)
            found = components(found.union(materialize(links)))
        links = self.cross_links(members, found)
        found = components(found.union(materialize(links)))
        classes = self.classes.join(found, "node", "left").select(
            "set_id", F.coalesce("component", "node").alias("component")
        )
        own = self.rows.select("doc_id", "n_shingles", "set_id")
        own = in_tasks(own.join(in_tasks(classes, self.n_rows), "set_id", "left"), self.n_rows)
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return own.select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return Similar(docs, words, percent, miss).result()


def keep_one_each(docs: DataFrame, words: int = WORDS, percent: int = 80, miss: float = MISS) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id, columns as they were."""
    dropped = near_duplicates(docs, words, percent, miss).filter(~F.col("kept")).select("doc_id")
    dropped = sent_if_small(dropped.distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("own_id"))
    return rows.join(dropped, rows.own_id == dropped.doc_id, "left_anti").select("row.*")
