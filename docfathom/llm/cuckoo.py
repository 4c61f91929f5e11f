"""Exact de-duplication by a sharded cuckoo-filter index over live digests.

A text's digest is the SHA-256 of its UTF-8 bytes without ASCII white space. The
high bits of a digest name its shard. A shard is a cuckoo filter (four 16-bit
fingerprints a bucket, partial-key hashing) beside a table of the stored keys,
bucketed the same way. A digest that the filter does not know is new; a hit is
checked against the content kept in its bucket: the whole digest and the number of
bytes. When an insertion finds no place after ``MAX_KICKS`` moves, the shard
doubles its buckets and is filled again from its stored keys. Deleting takes the
fingerprint out once the last copy goes.

Null text is the empty text, and all empty texts are copies of each other. Of
equal texts the row with most code points in its original text stays, then the
smallest ``doc_id`` (null last). Rows that repeat the id of the row that stays
count as that row. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docfathom.operators.spread import sent_if_small
from docfathom.session import materialize

SLOTS = 4
MAX_KICKS = 200
FIRST_BUCKETS = 256
#: Digests that a shard is planned for; the number of shards follows the input.
SHARD_KEYS = 100_000
#: The index as a table: one row per live digest.
INDEX_SCHEMA = "digest binary, n_bytes long, copies long"


class CuckooShard:
    """A cuckoo filter with the keys it stands for."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self.kept: dict[int, list[list]] = {}
        self.n_keys = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.n_buckets = buckets
        self.slots = np.zeros((buckets, SLOTS), np.uint16)

    def _prints(self, digest: bytes) -> tuple[int, int]:
        """Fingerprint (never 0) and first bucket."""
        return int.from_bytes(digest[8:10], "big") or 1, int.from_bytes(digest[10:18], "big") % self.n_buckets

    def _other(self, bucket: int, fingerprint: int) -> int:
        # n_buckets is a power of two, so this leads back and forth.
        return (bucket ^ (fingerprint * 0x5BD1E995)) % self.n_buckets

    def may_hold(self, digest: bytes) -> bool:
        f, a = self._prints(digest)
        return bool((self.slots[a] == f).any() or (self.slots[self._other(a, f)] == f).any())

    def _place(self, digest: bytes) -> bool:
        f, at = self._prints(digest)
        for bucket in (at, self._other(at, f)):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = f
                return True
        for kick in range(MAX_KICKS):
            slot = (f + kick) % SLOTS
            f, self.slots[at, slot] = int(self.slots[at, slot]), f
            at = self._other(at, f)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = f
                return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, refilled from the stored keys; again if that overflows."""
        while True:
            self._clear(self.n_buckets * 2)
            if all(self._place(entry[0]) for bucket in self.kept.values() for entry in bucket):
                return

    def find(self, digest: bytes, n_bytes: int) -> list | None:
        """The entry of a live digest: [digest, bytes, copies, best]."""
        if not self.may_hold(digest):
            return None
        for entry in self.kept.get(int.from_bytes(digest[:8], "big"), ()):
            if entry[0] == digest and entry[1] == n_bytes:
                return entry
        return None

    def insert(self, digest: bytes, n_bytes: int, copies: int, best=None) -> list:
        entry = self.find(digest, n_bytes)
        if entry:
            entry[2] += copies
            return entry
        entry = [digest, n_bytes, copies, best]
        self.kept.setdefault(int.from_bytes(digest[:8], "big"), []).append(entry)
        self.n_keys += 1
        if not self._place(digest):
            self._grow()
        return entry

    def delete(self, digest: bytes, n_bytes: int, copies: int) -> bool:
        """Take copies away; whether the digest was live. At 0 it is forgotten."""
        entry = self.find(digest, n_bytes)
        if not entry:
            return False
        entry[2] -= copies
        if entry[2] <= 0:
            key = int.from_bytes(digest[:8], "big")
            self.kept[key].remove(entry)
            self.n_keys -= 1
            f, at = self._prints(digest)
            for bucket in (at, self._other(at, f)):
                same = np.flatnonzero(self.slots[bucket] == f)
                if len(same):
                    self.slots[bucket, same[0]] = 0
                    break
        return True

    def entries(self):
        for bucket in self.kept.values():
            yield from bucket


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_bytes, n_points), a row for each row of ``docs``."""
    bare = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        without_space(F.col("text")).alias("bare"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"),
    )
    return bare.select(
        "doc_id",
        F.unhex(F.sha2(F.col("bare").cast("binary"), 256)).alias("digest"),
        F.octet_length("bare").cast("long").alias("n_bytes"),
        "n_points",
    )


def shard_of(digest: Column, shards: int) -> Column:
    """A digest's shard by its first bytes, which are uniform."""
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (points, id), the one that stays: most points, smallest id, null last."""

    def key(x):
        return (x[0], x[1] is not None, -(x[1] or 0))

    return a if key(a) >= key(b) else b


_COMBINED = "digest binary, n_bytes long, copies long, n_points long, doc_id long"


def _combine(batches):
    """Equal digests of one task as one row, so that hot texts travel once a task."""
    held: dict[tuple, list] = {}

    def out():
        columns = zip(*((d, n, v[0], *v[1]) for (d, n), v in held.items()))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)],
            ["digest", "n_bytes", "copies", "n_points", "doc_id"],
        )

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("digest", "n_bytes", "n_points", "doc_id")))
        for digest, n_bytes, points, doc_id in rows:
            entry = held.setdefault((digest, n_bytes), [0, (points, doc_id)])
            entry[0] += 1
            entry[1] = _better(entry[1], (points, doc_id))
        if len(held) > SHARD_KEYS:
            yield out()
            held.clear()
    if held:
        yield out()


def groups(digests: DataFrame, shards: int) -> DataFrame:
    """Every distinct text by the index: (digest, n_bytes, keep_id, group_size).

    Rows reach their shard combined per task. Each shard inserts them: unknown
    digests are new groups, verified hits join theirs.
    """
    combined = digests.mapInArrow(_combine, _COMBINED).withColumn("shard", shard_of(F.col("digest"), shards))

    def index(batches):
        held: dict[int, CuckooShard] = {}
        for batch in batches:
            names = ("shard", "digest", "n_bytes", "copies", "n_points", "doc_id")
            for shard, digest, n_bytes, copies, points, doc_id in zip(
                *(batch.column(c).to_pylist() for c in names)
            ):
                own = held.get(shard)
                if own is None:
                    own = held[shard] = CuckooShard()
                entry = own.insert(digest, n_bytes, copies, (points, doc_id))
                entry[3] = _better(entry[3], (points, doc_id))
        for own in held.values():
            rows = [(e[0], e[1], e[3][1], e[2]) for e in own.entries()]
            for a in range(0, len(rows), 10_000):
                columns = zip(*rows[a : a + 10_000])
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                    ["digest", "n_bytes", "keep_id", "group_size"],
                )

    schema = "digest binary, n_bytes long, keep_id long, group_size long"
    return combined.repartition(shards, "shard").mapInArrow(index, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(digested(docs))
    shards = max(1, -(-digests.count() // SHARD_KEYS))
    # AQE splits the rows of a hot digest on the left side.
    return digests.join(groups(digests, shards), ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and no others."""
    dropped = dedup(docs).filter(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("sha"))
    dropped = sent_if_small(dropped.distinct(), F.lit(64))
    # The row goes along as one value, so that no name of it can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select(
        "row",
        F.col("row.doc_id").cast("long").alias("own_id"),
        F.sha2(without_space(F.col("row.text")).cast("binary"), 256).alias("own_sha"),
    )
    same = (rows.own_sha == dropped.sha) & rows.own_id.eqNullSafe(dropped.doc_id)
    return rows.join(dropped, same, "left_anti").select("row.*")


def change_index(index: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """The index after deletions, then insertions, with what each change met.

    ``changes`` has ``op`` ('insert' or 'delete'), ``digest``, ``n_bytes`` and
    ``copies``. Rows out are the live digests (``op`` null) and the changes with
    ``found``: whether the digest was live when the change came. Write them, keep
    the live ones as the next index, and answer from the rest.
    """
    live = index.select(
        F.lit(None).cast("string").alias("op"), "digest", "n_bytes", F.col("copies").cast("long").alias("copies")
    )
    asked = changes.select(
        "op", "digest", F.col("n_bytes").cast("long").alias("n_bytes"), F.col("copies").cast("long").alias("copies")
    )
    # Copies of one change are added up before they travel.
    asked = asked.groupBy("op", "digest", "n_bytes").agg(F.sum("copies").alias("copies"))
    rows = live.unionByName(asked).withColumn("shard", shard_of(F.col("digest"), shards))

    def run(key, frame):
        shard = CuckooShard()
        out = []
        order = frame["op"].map({"delete": 1, "insert": 2}).fillna(0)
        for row in frame.iloc[np.argsort(order, kind="stable")].itertuples():
            if not isinstance(row.op, str):
                shard.insert(row.digest, row.n_bytes, row.copies)
            elif row.op == "delete":
                out.append(("delete", row.digest, row.n_bytes, row.copies, shard.delete(row.digest, row.n_bytes, row.copies)))
            else:
                found = shard.find(row.digest, row.n_bytes) is not None
                shard.insert(row.digest, row.n_bytes, row.copies)
                out.append(("insert", row.digest, row.n_bytes, row.copies, found))
        out += [(None, e[0], e[1], e[2], None) for e in shard.entries()]
        return pd.DataFrame(out, columns=["op", "digest", "n_bytes", "copies", "found"])

    schema = "op string, digest binary, n_bytes long, copies long, found boolean"
    return rows.repartition(shards, "shard").groupBy("shard").applyInPandas(run, schema)
