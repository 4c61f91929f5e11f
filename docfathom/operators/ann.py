"""Approximate top-k: coarse cells of near vectors, of which a query visits a few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docfathom.functions.documents import clamp_limit
from docfathom.functions.vectors import dot, list_matrix
from docfathom.operators.similarity import nearest_in_cells, ranked_order, search_topk_batch, searchable
from docfathom.session import materialize


def train_cells(corpus: DataFrame, cells: int = 32, seed: int = 7) -> np.ndarray:
    """Centres of ``cells`` clusters of all the corpus vectors (a bounded matrix).

    Only vectors of the most common size train (the larger size on a tie): a
    re-embedding in progress leaves two sizes. No vectors: no centres.
    """
    vectors = searchable(corpus).filter("embedding IS NOT NULL").select("embedding")
    # A zero vector has no direction to train on.
    vectors = vectors.filter(dot(F.col("embedding"), F.col("embedding")) > 0)
    sizes = vectors.groupBy(F.size("embedding").alias("dims")).count()
    common = sizes.orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if common is None:
        return np.zeros((0, 0))
    vectors = vectors.filter(F.size("embedding") == common.dims)
    training = materialize(vectors.select(array_to_vector(F.col("embedding")).alias("features")))
    model = KMeans(k=cells, seed=seed, maxIter=20, distanceMeasure="cosine").fit(training)
    centres = np.array([np.asarray(centre) for centre in model.clusterCenters()])
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def nearest_cells(vector: Column, centres: np.ndarray, nprobe: int = 1) -> Column:
    """Numbers of the ``nprobe`` cells nearest to a vector, nearest first."""
    nprobe = min(nprobe, len(centres))
    places = centres.T

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def choose(vectors: pa.Array) -> pa.Array:
        matrix, fits = list_matrix(vectors, len(places))
        chosen = np.argsort(-(matrix @ places), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
        rows = iter(chosen.tolist())
        return pa.array([next(rows) if fit else None for fit in fits], pa.list_(pa.int32()))

    return choose(vector)


def cell_of(tenant_id: str, number: str) -> Column:
    """A name that no other tenant's cell has. Vectors that fit no centre have NULL
    for their number, and so a cell of their own in each tenant."""
    return F.to_json(F.array(F.col(tenant_id), F.col(number).cast("string"))).alias("cell")


def search_ann(
    corpus: DataFrame,
    queries: DataFrame,
    centres: np.ndarray,
    nprobe: int = 8,
    **options,
) -> DataFrame:
    """Top-k among the tenant's documents in the query's ``nprobe`` nearest cells.

    Scores are exact; only documents in other cells can be missed.
    """
    docs = (
        searchable(corpus)
        .withColumn("number", nearest_cells(F.col("embedding"), centres)[0])
        .select(cell_of("tenant_id", "number"), "id", "embedding")
    )
    wanted = (
        queries.withColumn("number", F.explode_outer(nearest_cells(F.col("query_vec"), centres, nprobe)))
        .select(
            "query_id",
            cell_of("tenant_id", "number"),
            "query_vec",
            clamp_limit(F.col("limit")).alias("limit"),
        )
    )
    return nearest_in_cells(docs, wanted, **options)


def ann_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact results that the approximate ones contain."""
    found = approximate.select("query_id", "id", F.lit(1).alias("hit"))
    return (
        exact.join(found, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
        .agg(
            F.count("*").alias("n_queries"),
            F.sum("n_exact").alias("n_exact"),
            F.sum("n_found").alias("n_found"),
            (F.sum("n_found") / F.sum("n_exact")).alias("recall"),
        )
    )


#: Cells every query visits before the bounds are consulted.
FIRST_CELLS = 4
#: Room for rounding in the bound, so that a document it should admit is never cut.
BOUND_SLACK = 1e-9


def centre_cosines(vector: Column, centres: np.ndarray) -> Column:
    """Cosine of a vector to every centre; NULL for NULL, zero or other-sized vectors."""
    places = centres.T

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def cosines(vectors: pa.Array) -> pa.Array:
        matrix, fits = list_matrix(vectors, len(places))
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        rows = iter((matrix @ places / np.where(lengths > 0, lengths, 1.0)[:, None]).tolist())
        zero = iter(lengths == 0)
        out = []
        for fit in fits:
            if not fit:
                out.append(None)
                continue
            row = next(rows)
            out.append(None if next(zero) else row)
        return pa.array(out, pa.list_(pa.float64()))

    return cosines(vector)


def search_pruned(
    corpus: DataFrame,
    queries: DataFrame,
    centres: np.ndarray,
    first_cells: int = FIRST_CELLS,
    **options,
) -> DataFrame:
    """Exact top-k among a tenant's documents that visits only the cells that can matter.

    Each document is filed under its nearest centre, and each cell of a tenant
    keeps the least cosine of its members to the centre (its angular radius r).
    A query first scores its ``first_cells`` nearest cells; its k-th similarity s
    is then a floor. A cell whose centre lies at angle t from the query holds no
    document nearer than angle max(0, t - r), so only cells with
    cos(max(0, t - r)) >= s are scored in a second round. Vectors that fit no
    centre form a cell of their tenant that is always scored. The answer equals
    exact search, ties included; how much is skipped depends on how clustered
    the vectors are.
    """
    if len(centres) == 0:
        return search_topk_batch(corpus, queries, **options)
    docs = materialize(
        searchable(corpus)
        .withColumn("cosines", centre_cosines(F.col("embedding"), centres))
        .select(
            "tenant_id", "id", "embedding",
            (F.array_position("cosines", F.array_max("cosines")) - 1).cast("int").alias("number"),
            F.array_max("cosines").alias("member_cos"),
        )
    )
    cells = docs.groupBy("tenant_id", "number").agg(F.min("member_cos").alias("least_cos"))
    stored = docs.select(cell_of("tenant_id", "number"), "id", "embedding")

    asked = queries.select(
        "query_id", "tenant_id", "query_vec", clamp_limit(F.col("limit")).alias("limit"),
        centre_cosines(F.col("query_vec"), centres).alias("cosines"),
    )
    nearest_first = Window.partitionBy("query_id").orderBy(F.col("query_cos").desc(), "number")
    per_cell = (
        asked.select("query_id", "tenant_id", "query_vec", "limit", F.posexplode("cosines").alias("number", "query_cos"))
        .withColumn("order", F.row_number().over(nearest_first))
        .join(cells, ["tenant_id", "number"])
    )
    # A query without a direction (NULL, zero or of another size) has no bound: it visits every cell.
    without_cell = asked.filter(F.col("cosines").isNull()).join(cells.select("tenant_id", "number"), "tenant_id").select(
        "query_id", "tenant_id", "query_vec", "limit", "number"
    )

    def visit(rows: DataFrame) -> DataFrame:
        return rows.select("query_id", cell_of("tenant_id", "number"), "query_vec", "limit")

    first = materialize(
        nearest_in_cells(stored, visit(
            per_cell.filter(F.col("order") <= first_cells).select(*without_cell.columns).unionByName(without_cell)
        ), **options)
    )
    floor = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("similarity").alias("kth"))
    angle = F.greatest(
        F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("query_cos"))))
        - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("least_cos")))),
        F.lit(0.0),
    )
    later = (
        per_cell.filter(F.col("order") > first_cells)
        .join(floor, "query_id", "left")
        .filter(
            F.col("kth").isNull()
            | (F.col("found") < F.col("limit"))
            | (F.cos(angle) + BOUND_SLACK >= F.col("kth"))
        )
        .select("query_id", "tenant_id", "query_vec", "limit", "number")
    )
    # Documents whose vector fits no centre are in a cell of their own, scored for every query.
    homeless = (
        asked.join(cells.filter(F.col("number").isNull()).select("tenant_id"), "tenant_id")
        .filter(F.col("cosines").isNotNull())
        .select("query_id", "tenant_id", "query_vec", "limit", F.lit(None).cast("int").alias("number"))
    )
    second = nearest_in_cells(stored, visit(later.unionByName(homeless)), **options)
    limits = asked.select("query_id", "limit")
    best = Window.partitionBy("query_id").orderBy(*ranked_order())
    return (
        first.unionByName(second.select(*first.columns))
        .join(limits, "query_id")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= F.col("limit"))
        .select("query_id", "rank", "id", "similarity")
    )
