"""Vector expressions: column forms, and an Arrow form for wide vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Similarities that agree to this many decimals count as equal and are ordered
# by id, so that rounding noise in a sum cannot reorder exact copies.
TIE_DECIMALS = 12


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(left: Column, right: Column) -> Column:
    """NULL for a zero vector, a missing vector or vectors of unlike size."""
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left) * dot(right, right)))


def cosine_distance(left: Column, right: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(left, right)


def tie_key(similarity: Column) -> Column:
    return F.round(similarity, TIE_DECIMALS)


def quantized(vector: Column) -> Column:
    """Text form of a vector at six decimals, for keys and comparisons."""
    return F.array_join(
        F.transform(
            vector, lambda x: F.round(x.cast("double") * F.lit(1e6)).cast("bigint").cast("string")
        ),
        ",",
    )


def list_matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as one matrix, and which rows have ``dims`` values.

    Rows that are NULL or of another size are left out of the matrix.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = sizes == dims
    if not fits.all():
        column = column.filter(pa.array(fits))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dims).astype(np.float64), fits


def similarity_to(query: Sequence[float]):
    """An Arrow function giving each vector's cosine similarity to ``query``.

    The column form interprets every element; this one is a single product per
    Arrow batch, which is what pays at hundreds of dimensions.
    """
    target = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(target @ target))

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array) -> pa.Array:
        result = np.full(len(vectors), np.nan)
        if length > 0:
            matrix, fits = list_matrix(vectors, len(target))
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            with np.errstate(divide="ignore", invalid="ignore"):
                scored = matrix @ target / (norms * length)
            result[fits] = np.where(norms > 0, scored, np.nan)
        return pa.array(result, mask=np.isnan(result))

    return score
