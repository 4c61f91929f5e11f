"""Tenant-scoped top-k by cosine similarity, exact.

Search inputs are a corpus ``(id, tenant_id, status, embedding, ...)`` and, for
many queries at once, a query table ``(query_id, tenant_id, query_vec, limit)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from docfathom.functions.documents import clamp_limit, query_reject_reason
from docfathom.functions.vectors import (
    TIE_DECIMALS,
    cosine_similarity,
    list_matrix,
    similarity_to,
    tie_key,
)
from docfathom.operators.spread import lookup_join
from docfathom.schemas import DEFAULT_LIMIT, INDEXED, MAX_LIMIT

# Queries whose vectors take at most this much are sent to every task.
SENT_QUERY_BYTES = 64 << 20
SENT_QUERY_ROWS = 100_000
# Hits a task may have to keep for them until its documents are scored.
SENT_QUERY_HITS = 2_000_000
# Cells whose block layout (a name and two numbers each) is broadcast.
SENT_CELLS = 500_000
# Rows of one side of a scoring block when both sides are shuffled.
BLOCK_ROWS = 4096
# Scores computed at a time inside a task.
SCORE_CELLS = 4 << 20
# Ranks below every real similarity, for a vector that has none.
NO_SIMILARITY = -2.0

# Cells named one by one in the scan's filter; more are joined in.
FILTERED_CELLS = 1000

HIT_SCHEMA = "query_id string, id string, similarity double, limit int"
HIT_ARROW = pa.schema(
    [
        ("query_id", pa.string()),
        ("id", pa.string()),
        ("similarity", pa.float64()),
        ("limit", pa.int32()),
    ]
)


def searchable(corpus: DataFrame, tenant_id: str | None = None) -> DataFrame:
    rows = corpus.filter(F.col("status") == INDEXED)
    return rows if tenant_id is None else rows.filter(F.col("tenant_id") == tenant_id)


def ranked_order() -> list[Column]:
    return [tie_key(F.col("similarity")).desc_nulls_last(), F.col("id").asc()]


def search_topk(
    corpus: DataFrame,
    tenant_id: str,
    query_vec: Sequence[float],
    limit: int = 10,
    arrow: bool = True,
) -> DataFrame:
    """The ``limit`` documents of one tenant nearest to one query vector.

    Each partition keeps ``limit`` rows and one task merges them, so nothing but
    those rows is shuffled. Only ids and vectors are read for that; the other columns
    are fetched for the documents found. ``arrow=False`` scores with column
    expressions.
    """
    limit = DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)
    vector = [float(x) for x in query_vec]
    if arrow:
        similarity = similarity_to(vector)(F.col("embedding"))
    else:
        similarity = cosine_similarity(F.col("embedding"), F.lit(vector))
    docs = searchable(corpus, tenant_id)
    best = docs.select("id", similarity.alias("similarity")).orderBy(*ranked_order()).limit(limit)
    # At most MAX_LIMIT rows are sent.
    return docs.drop("embedding").join(F.broadcast(best), "id").orderBy(*ranked_order())


def split_queries(queries: DataFrame, text: str = "query") -> tuple[DataFrame, DataFrame]:
    """Queries that can be searched, and the rejected ones with their reason."""
    checked = queries.withColumn("reject_reason", query_reject_reason(F.col(text)))
    return (
        checked.filter("reject_reason IS NULL").drop("reject_reason"),
        checked.filter("reject_reason IS NOT NULL"),
    )


def search_topk_batch(
    corpus: DataFrame,
    queries: DataFrame,
    sent_query_bytes: int = SENT_QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, id, similarity)`` for a table of queries."""
    docs = searchable(corpus).select(F.col("tenant_id").alias("cell"), "id", "embedding")
    wanted = queries.select(
        "query_id",
        F.col("tenant_id").alias("cell"),
        "query_vec",
        clamp_limit(F.col("limit")).alias("limit"),
    )
    return nearest_in_cells(docs, wanted, sent_query_bytes, block_rows)


def search_same_model(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Top-k over documents embedded by the query's own model (column ``model``)."""
    docs = searchable(corpus).select(
        model_cell(F.col("tenant_id"), F.col("model")), "id", "embedding"
    )
    wanted = queries.select(
        "query_id",
        model_cell(F.col("tenant_id"), F.col("model")),
        "query_vec",
        clamp_limit(F.col("limit")).alias("limit"),
    )
    return nearest_in_cells(docs, wanted)


def model_cell(tenant_id: Column, model: Column) -> Column:
    return F.to_json(F.array(tenant_id, model)).alias("cell")


def other_model_counts(corpus: DataFrame, model: str) -> DataFrame:
    """Per tenant, the searchable documents a query of ``model`` has to skip."""
    other = ~F.col("model").eqNullSafe(F.lit(model))
    return (
        searchable(corpus)
        .groupBy("tenant_id")
        .agg(F.count("*").alias("n_indexed"), F.count_if(other).alias("n_skipped"))
    )


def nearest_in_cells(
    docs: DataFrame,
    queries: DataFrame,
    sent_query_bytes: int = SENT_QUERY_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top-k of every query among the documents that share a ``cell`` with it.

    ``docs`` is ``(cell, id, embedding)``; ``queries`` is ``(query_id, cell,
    query_vec, limit)``, one row per cell a query looks into. No pair of a query
    and a document ever becomes a row: a task multiplies blocks of vectors and
    gives back at most ``limit`` rows per query.
    """
    queries = queries.filter(F.col("query_vec").isNotNull())
    size = queries.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(F.size("query_vec")), F.lit(0)).alias("floats"),
        F.coalesce(F.sum("limit"), F.lit(0)).alias("hits"),
        F.countDistinct("cell").alias("cells"),
    ).first()
    if (
        size.rows <= SENT_QUERY_ROWS
        and size.hits <= SENT_QUERY_HITS
        and size.floats * 8 <= sent_query_bytes
    ):
        return rank_hits(_score_where_stored(docs, queries))
    return rank_hits(_score_in_blocks(docs, queries, block_rows, size.cells <= SENT_CELLS))


def rank_hits(hits: DataFrame) -> DataFrame:
    """Merge the tasks' own top-k lists.

    The constant bound lets Spark cut each partition before the shuffle.
    """
    per_query = Window.partitionBy("query_id").orderBy(*ranked_order())
    return (
        hits.withColumn("rank", F.row_number().over(per_query))
        .filter(F.col("rank") <= MAX_LIMIT)
        .filter(F.col("rank") <= F.col("limit"))
        .select("query_id", "rank", "id", "similarity")
    )


def _score_where_stored(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Send the (few) queries to the tasks that scan the documents."""
    spark = docs.sparkSession
    cells: dict[str, QueryBlock] = {}
    table = queries.select("cell", "query_id", "query_vec", "limit").toArrow()
    for cell, rows in _by_value(table["cell"]):
        cells[cell] = QueryBlock.of(table.take(pa.array(rows)))
    sent = spark.sparkContext.broadcast(cells)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, BestHits] = {}
        for batch in batches:
            for cell, rows in _by_value(batch.column("cell")):
                block = sent.value.get(cell)
                if block is None:
                    continue
                if cell not in best:
                    best[cell] = BestHits(block)
                part = batch.take(pa.array(rows))
                best[cell].add(part.column("id"), part.column("embedding"))
        for hits in best.values():
            yield from hits.result().to_batches()

    # Documents of cells nobody asks about need not be read, or reach Python.
    if len(cells) <= FILTERED_CELLS:
        asked = docs.filter(F.col("cell").isin(list(cells)))
    else:
        # At most one row per query, and the queries were counted above.
        names = F.broadcast(queries.select("cell").distinct())
        asked = docs.join(names, "cell", "left_semi")
    return asked.mapInArrow(score, HIT_SCHEMA)


def _score_in_blocks(
    docs: DataFrame, queries: DataFrame, block_rows: int, few_cells: bool
) -> DataFrame:
    """Shuffle both sides into blocks of bounded size and score block pairs.

    A cell with many documents or many queries becomes many blocks, so no task
    holds more than ``block_rows`` (give or take hashing) of either side.
    """

    def blocks_of(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(
            F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(name)
        )

    layout = blocks_of(docs, "doc_blocks").join(blocks_of(queries, "query_blocks"), "cell")

    def block_of(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def place(rows: DataFrame, key: str) -> DataFrame:
        if few_cells:
            return rows.join(F.broadcast(layout), "cell")
        return lookup_join(rows, layout, ["cell"], F.col(key))

    placed_docs = (
        place(docs, "id")
        .withColumn("doc_block", block_of("id", "doc_blocks"))
        .withColumn("query_block", every("query_blocks"))
        .select("cell", "doc_block", "query_block", "id", "embedding")
    )
    placed_queries = (
        place(queries, "query_id")
        .withColumn("query_block", block_of("query_id", "query_blocks"))
        .withColumn("doc_block", every("doc_blocks"))
        .select("cell", "doc_block", "query_block", "query_id", "query_vec", "limit")
    )
    keys = ["cell", "doc_block", "query_block"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return HIT_ARROW.empty_table()
        hits = BestHits(QueryBlock.of(right))
        hits.add(left["id"].combine_chunks(), left["embedding"].combine_chunks())
        return hits.result()

    return (
        placed_docs.groupBy(*keys)
        .cogroup(placed_queries.groupBy(*keys))
        .applyInArrow(score, HIT_SCHEMA)
    )


def _by_value(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[str, np.ndarray]]:
    """Each distinct value of a column with the positions that hold it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    encoded = column.dictionary_encode()
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(encoded.dictionary) + 1))
    for code, value in enumerate(encoded.dictionary.to_pylist()):
        yield value, order[starts[code] : starts[code + 1]]


class QueryBlock:
    """Unit vectors and limits of some queries, grouped by vector size."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]):
        self.parts = parts

    @classmethod
    def of(cls, table: pa.Table) -> "QueryBlock":
        ids = np.array(table["query_id"].to_pylist(), dtype=object)
        limits = table["limit"].to_numpy()
        vectors = table["query_vec"].combine_chunks()
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        parts = []
        for dims in np.unique(sizes):
            matrix, fits = list_matrix(vectors, int(dims))
            parts.append((ids[fits], _unit(matrix), limits[fits], int(dims)))
        return cls(parts)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN."""
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / norms[:, None]


class BestHits:
    """Running top-k of a block of queries over batches of documents."""

    def __init__(self, block: QueryBlock):
        self.block = block
        self.kept = [_empty_hits() for _ in block.parts]

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        for number, (_, queries, limits, dims) in enumerate(self.block.parts):
            matrix, fits = list_matrix(vectors, dims)
            docs = np.full((len(ids), dims), np.nan)
            docs[fits] = _unit(matrix)
            k = int(limits.max())
            step = max(1, SCORE_CELLS // max(1, len(ids)))
            found = [self.kept[number]]
            order = _id_order(ids) if len(ids) > k else None
            for start in range(0, len(queries), step):
                scores = np.round(queries[start : start + step] @ docs.T, TIE_DECIMALS)
                scores[np.isnan(scores)] = NO_SIMILARITY
                found.append(_candidates(scores, ids, k, start, order))
            self.kept[number] = _cut(pa.concat_tables(found), limits)

    def result(self) -> pa.Table:
        tables = [HIT_ARROW.empty_table()]
        for (query_ids, _, limits, _), kept in zip(self.block.parts, self.kept):
            score, query = kept["score"].to_numpy(), kept["query"].to_numpy()
            tables.append(
                pa.table(
                    [
                        pa.array(query_ids[query], type=pa.string()),
                        kept["id"],
                        pa.array(score, mask=score == NO_SIMILARITY),
                        pa.array(limits[query], type=pa.int32()),
                    ],
                    schema=HIT_ARROW,
                )
            )
        return pa.concat_tables(tables).combine_chunks()


def _empty_hits() -> pa.Table:
    return pa.schema(
        [("query", pa.int64()), ("score", pa.float64()), ("id", pa.string())]
    ).empty_table()


def _candidates(scores: np.ndarray, ids: pa.Array, k: int, first: int, id_order: np.ndarray | None = None) -> pa.Table:
    """Each row's k best scores; ties at the k-th go to the smaller id.

    ``id_order`` ranks the ids as ``_cut`` orders them (nulls last). However
    many scores are equal, at most k rows a query leave here.
    """
    width = scores.shape[1]
    if width > k:
        if id_order is None:
            id_order = _id_order(ids)
        bar = np.partition(scores, width - k, axis=1)[:, width - k]
        above = scores > bar[:, None]
        level = scores == bar[:, None]
        # The bar is the k-th best, so at most k - 1 scores lie above it.
        need = k - above.sum(axis=1)
        key = np.where(level, id_order[None, :], width)
        smallest = np.sort(np.partition(key, k - 1, axis=1)[:, :k], axis=1)
        last = smallest[np.arange(len(need)), need - 1]
        rows, columns = np.nonzero(above | (level & (key <= last[:, None])))
    else:
        rows, columns = (axis.ravel() for axis in np.indices(scores.shape))
    return pa.table(
        {
            "query": pa.array(rows + first, type=pa.int64()),
            "score": pa.array(scores[rows, columns]),
            "id": ids.take(pa.array(columns)),
        },
        schema=_empty_hits().schema,
    )


def _id_order(ids: pa.Array) -> np.ndarray:
    """Rank of every id in ascending order, nulls last."""
    names = ids.to_pylist()
    order = np.empty(len(names), dtype=np.int64)
    order[sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))] = np.arange(len(names))
    return order


def _cut(found: pa.Table, limits: np.ndarray) -> pa.Table:
    """Keep each query's best rows: by score, then by id."""
    ordered = found.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = ordered["query"].to_numpy()
    position = np.arange(len(query)) - np.searchsorted(query, query)
    return ordered.filter(pa.array(position < limits[query]))


