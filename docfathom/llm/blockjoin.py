"""Nearest neighbours by a block matrix join of int8 tiles.

Queries and candidates are packed into blocks: an int8 matrix, a scale a row, the
length and the quantisation error of each row, and the vectors themselves. A tile is
the product of a query block and a candidate block. With q = q' + e and c = c' + f,
|q.c - q'.c'| <= |e| |c| + |q'| |f|, so the int8 product gives each pair a lower and
an upper bound. Pairs whose upper bound reaches the k-th largest lower bound of their
query survive and are computed again from the vectors, in double precision. A tile
hands on its k best per query; heaps merge the tiles' answers.

The search is exact: recall is 1. Equal vectors of a block are multiplied once, and
only the k + 1 smallest of their ids can count, so very common vectors cost nothing.

Vectors that are null, zero, or hold a null or non-finite component take no part,
neither do rows without an id. Vectors of different length are not compared. A row's
own id is no candidate of it, however often it occurs; rows that repeat an id count
each. Equal scores go to the smaller id. Fewer candidates than k are all returned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docfathom.session import materialize

QUERY_BLOCK, BLOCK = 2048, 4096
#: Candidate blocks that meet one copy of a query block.
GROUP_BLOCKS = 2
#: Queries whose heaps one task holds.
MERGED_QUERIES = 1 << 14
#: Pairs computed at once in double precision.
EXACT_PAIRS = 1 << 16
#: Queries of a tile whose bounds are held at once.
STRIPE = 256
PACKED = "block long, dims int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    inf = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantized(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, lengths of what they stand for, and of the error."""
    scale = np.abs(vectors).max(axis=1) / 127
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    meant = small * scale[:, None]
    return small, scale, np.linalg.norm(meant, axis=1), np.linalg.norm(vectors - meant, axis=1)


def _unpacked(row_ids: bytes, row_vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row_ids, np.int64), np.frombuffer(row_vectors, np.float64).reshape(-1, dims)


def _int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int8 matrices; in float32 as long as sums stay below 2^24."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def tile_nearest(query_ids, queries, ids, vectors, k: int):
    """(query index, id, score) of each query's k nearest in one tile, exact."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))
    distinct = vectors[first]
    # Ids of one vector are in order; one more than k, as the query's own may be there.
    few = np.minimum(last - first, k + 1)
    small, scale, length, error = quantized(distinct)
    q_small, q_scale, q_length, q_error = quantized(queries)
    whole = length + error
    k_th = min(k + 1, len(first))
    out_q, out_id, out_score = [], [], []
    for a in range(0, len(queries), STRIPE):
        s = slice(a, a + STRIPE)
        near = _int8_product(q_small[s], small) * (q_scale[s, None] * scale)
        slack = q_error[s, None] * whole + q_length[s, None] * error
        slack += 1e-6 * (q_length[s, None] + q_error[s, None]) * whole  # of rounding
        lower = near - slack
        # k + 1 distinct vectors hold k candidates at least besides the query's own.
        bar = np.partition(lower, len(first) - k_th, axis=1)[:, len(first) - k_th]
        rows, columns = np.nonzero(near + slack >= bar[:, None])
        for b in range(0, len(rows), EXACT_PAIRS):
            r, c = rows[b : b + EXACT_PAIRS], columns[b : b + EXACT_PAIRS]
            score = (queries[a + r] * distinct[c]).sum(axis=1)
            copies = few[c]
            ahead = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            r, found = np.repeat(r, copies), ids[np.repeat(first[c], copies) + ahead]
            score = np.repeat(score, copies)
            other = found != query_ids[a + r]
            out_q.append(a + r[other])
            out_id.append(found[other])
            out_score.append(score[other])
    q, found, score = map(np.concatenate, (out_q, out_id, out_score))
    order = np.lexsort((found, -score, q))
    q, found, score = q[order], found[order], score[order]
    starts = np.searchsorted(q, q)
    keep = np.arange(len(q)) - starts < k
    return q[keep], found[keep], score[keep]


def _pack(rows: int):
    """Rows of (id, vector) as blocks of equal vector length."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        count = 0

        def block(dims):
            nonlocal count
            ids, vectors = held.pop(dims)
            count += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([count], pa.int64()),
                    "dims": pa.array([dims], pa.int32()),
                    "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                    "vectors": pa.array([np.array(vectors, np.float64).tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            for i, vector in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist()):
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(i)
                vectors.append(vector)
                if len(ids) == rows:
                    yield block(len(vector))
        for dims in list(held):
            yield block(dims)

    return run


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """``vectors`` (id, vector) packed, with a number for each block."""
    packed = vectors.mapInArrow(_pack(rows), PACKED)
    return packed.withColumn("block", F.monotonically_increasing_id())


def nearest(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest of each query among all rows: query_id, rank, vec_id, score."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    asking = rows.filter("asks").select("id", "vector")
    # Queries are few a partition; gathered, they fill their blocks.
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    gathered = asking.repartition(max(1, -(-n_queries // QUERY_BLOCK)), F.xxhash64("id"))
    query_blocks = materialize(blocks(gathered, QUERY_BLOCK))
    # What is known of query blocks is their numbers: one for QUERY_BLOCK queries.
    numbers = query_blocks.select(F.col("dims"), F.col("block").alias("query_block"))
    candidates = blocks(rows.select("id", "vector"), BLOCK)
    # Few query blocks would be few keys, so each goes to several groups of candidates.
    groups = max(1, -(-n_rows // (BLOCK * GROUP_BLOCKS)))
    tiles = (
        candidates.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
        .join(numbers.groupBy("dims").agg(F.collect_list("query_block").alias("query_blocks")), "dims")
        .select("dims", F.explode("query_blocks").alias("query_block"), "group", "ids", "vectors")
        .join(
            query_blocks.select(
                F.col("block").alias("query_block"),
                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"),
                F.col("ids").alias("query_ids"),
                F.col("vectors").alias("queries"),
            ),
            ["query_block", "group"],
        )
    )

    def products(batches):
        for batch in batches:
            names = ("query_block", "dims", "query_ids", "queries", "ids", "vectors")
            for number, dims, *packed in zip(*(batch.column(c).to_pylist() for c in names)):
                query_ids, queries = _unpacked(packed[0], packed[1], dims)
                q, found, score = tile_nearest(query_ids, queries, *_unpacked(packed[2], packed[3], dims), k)
                # A query block and a row of it name a query, as an id may be repeated.
                for a in range(0, len(q), 65536):
                    s = slice(a, a + 65536)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_block": pa.array(np.full(len(q[s]), number), pa.int64()),
                            "row": pa.array(q[s], pa.int64()),
                            "query_id": pa.array(query_ids[q[s]], pa.int64()),
                            "vec_id": pa.array(found[s], pa.int64()),
                            "score": pa.array(score[s], pa.float64()),
                        }
                    )

    def merge(batches):
        heaps: dict[tuple[int, int, int], list[tuple[float, int]]] = {}
        for batch in batches:
            names = ("query_block", "row", "query_id", "score", "vec_id")
            for number, row, query_id, score, found in zip(*(batch.column(c).to_pylist() for c in names)):
                heap = heaps.setdefault((number, row, query_id), [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -found))
                elif (score, -found) > heap[0]:
                    heapq.heapreplace(heap, (score, -found))
        out = [
            (query_id, rank, -found, score)
            for (_, _, query_id), heap in heaps.items()
            for rank, (score, found) in enumerate(sorted(heap, reverse=True), 1)
        ]
        for a in range(0, len(out), 65536):
            columns = zip(*out[a : a + 65536])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "rank", "vec_id", "score"]
            )

    best = tiles.mapInArrow(products, "query_block long, row long, query_id long, vec_id long, score double")
    return best.repartition(max(8, -(-n_queries // MERGED_QUERIES)), "query_block", "row").mapInArrow(
        merge, "query_id long, rank int, vec_id long, score double"
    )
