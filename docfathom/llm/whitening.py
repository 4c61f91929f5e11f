"""Embedding whitening: exact moments, a pivoted Cholesky factor, one-sided Jacobi.

Rows whose vector is null, or holds a null or non-finite entry, take no part.
Each remaining entry c becomes the integer x = floor(64 c) + 1,000,000. Vectors
are fitted by length: the fit list of a row is every remaining vector of its
length (the given tables have one length). With n vectors and sums S, the
covariance V is the mean of (x - S/n)(x - S/n)^T.

Method: every task sums n, S and the scatter sum of x x^T *exactly* (integers;
shifted by 1,000,000, which the covariance does not see), and Spark adds the
tasks' sums by cell, so no task or driver meets more than one matrix per length.
The driver then forms n^2 V = n G - S S^T exactly, takes a pivoted Cholesky
factor of V (P V P^T = L L^T, stopping at pivots below d * eps * max diag), and
orthogonalises the columns of L by one-sided Jacobi rotations (Hestenes):
L W = [c_1 ... c_r] with orthogonal columns, so V = sum c_k c_k^T; the squared
norms of the rotated columns are the eigenvalues and the normalised columns the
components. Only d x d numbers reach the driver.

Result: for each remaining row and each component k up to ``COMPONENTS`` with a
positive eigenvalue e_k (numbered from 1 by falling e, sign fixed so that the
largest entry is positive), the columns vec_id, component, n (fit list size),
deviation (sum over dimensions of (n x - S)^2, exact; null where it exceeds a
long), whitened ((x - S/n) . u_k / sqrt(e_k), centred exactly before the one
rounding), explained (e_k / trace V), identity_error (largest absolute entry of
the covariance of the whitened values minus the identity, measured over the fit
list in a second pass, one value per length).

Edge cases: an empty table, or a length with one vector or zero covariance, gives
no rows for it. Null vec_id is carried; repeated rows are rows of their own.
Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the contract: the grid of entries, its offset, components shown.
STEPS = 64
OFFSET = 1_000_000
COMPONENTS = 32

#: Rotation sweeps of the Jacobi method at most (it converges in about ten).
SWEEPS = 60
LONG_MAX = (1 << 63) - 1
#: Integer sums in float64 are exact below this magnitude.
EXACT_FLOAT = 1 << 53

MOMENT_SCHEMA = "dim int, i int, j int, value string"
PAIR_SCHEMA = "dim int, i int, j int, value double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>, dim) of rows that take part."""
    entries = F.col("embedding").cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select("vec_id", entries.alias("embedding")).filter(
        F.col("embedding").isNotNull() & ~bad
    ).withColumn("dim", F.size("embedding"))


def grid(values: np.ndarray) -> np.ndarray:
    """floor(64 c) of finite doubles, as int64 where it fits, else Python integers."""
    scaled = np.floor(values * STEPS)
    if scaled.size == 0 or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.array([int(v) for v in scaled.ravel()], dtype=object).reshape(scaled.shape)


def rows_of(batch, dim: int) -> np.ndarray:
    """The vectors of one length in a batch, as a (rows, dim) array of floor(64 c)."""
    column = batch.column("embedding")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return grid(flat.reshape(len(column), dim))


def gram(y: np.ndarray) -> tuple[object, np.ndarray, np.ndarray]:
    """(rows, sums, scatter) of integer rows, exactly, as Python integers."""
    n = y.shape[0]
    if y.dtype != object:
        top = int(np.abs(y).max(initial=0))
        # Float products and sums are exact while every partial sum stays below 2^53.
        chunk = EXACT_FLOAT // max(1, top * top) if top else n or 1
        if chunk >= 1 and top < (1 << 26):
            sums = np.zeros(y.shape[1], dtype=object)
            scatter = np.zeros((y.shape[1], y.shape[1]), dtype=object)
            for at in range(0, n, int(min(chunk, 1 << 20))):
                part = y[at : at + int(min(chunk, 1 << 20))].astype(np.float64)
                sums += np.array([int(v) for v in part.sum(axis=0)], dtype=object)
                scatter += np.vectorize(int, otypes=[object])(part.T @ part)
            return n, sums, scatter
        y = y.astype(object)
    return n, y.sum(axis=0), y.T.dot(y)


def moments(batches):
    """A mapInArrow function: a task's exact n, S and scatter, a row per cell."""
    import pyarrow as pa

    held: dict[int, list] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            n, sums, scatter = gram(rows_of(part, int(dim)))
            if int(dim) in held:
                old = held[int(dim)]
                held[int(dim)] = [old[0] + n, old[1] + sums, old[2] + scatter]
            else:
                held[int(dim)] = [n, sums, scatter]
    for dim, (n, sums, scatter) in held.items():
        cells = [(-1, -1, n)] + [(i, -1, sums[i]) for i in range(dim)]
        cells += [(i, j, scatter[i, j]) for i in range(dim) for j in range(i, dim)]
        yield pa.RecordBatch.from_pydict(
            {
                "dim": pa.array([dim] * len(cells), pa.int32()),
                "i": pa.array([c[0] for c in cells], pa.int32()),
                "j": pa.array([c[1] for c in cells], pa.int32()),
                "value": [str(int(c[2])) for c in cells],
            }
        )


def add_cells(batches):
    """A mapInArrow function: exact sums of the cells a shard holds."""
    import pyarrow as pa

    total: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        for dim, i, j, value in zip(*(batch.column(k).to_pylist() for k in ("dim", "i", "j", "value"))):
            total[(dim, i, j)] = total.get((dim, i, j), 0) + int(value)
    keys = sorted(total)
    yield pa.RecordBatch.from_pydict(
        {
            "dim": pa.array([k[0] for k in keys], pa.int32()),
            "i": pa.array([k[1] for k in keys], pa.int32()),
            "j": pa.array([k[2] for k in keys], pa.int32()),
            "value": [str(total[k]) for k in keys],
        },
        schema=pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.string())]),
    )


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with V[order][:, order] = L L^T, L of full-rank columns only."""
    d = v.shape[0]
    a = v.astype(np.float64).copy()
    order = np.arange(d)
    factor = np.zeros((d, d))
    tol = d * np.finfo(float).eps * max(float(np.max(np.diag(a))) if d else 0.0, 0.0)
    rank = 0
    for k in range(d):
        j = k + int(np.argmax(np.diag(a)[k:]))
        if a[j, j] <= tol:
            break
        if j != k:
            a[[k, j]] = a[[j, k]]
            a[:, [k, j]] = a[:, [j, k]]
            factor[[k, j]] = factor[[j, k]]
            order[[k, j]] = order[[j, k]]
        pivot = math.sqrt(a[k, k])
        factor[k, k] = pivot
        factor[k + 1 :, k] = a[k + 1 :, k] / pivot
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
        rank = k + 1
    return factor[:, :rank], order


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotate the columns of ``factor`` until they are orthogonal.

    Returns (eigenvalues, unit columns) of factor factor^T, by falling eigenvalue.
    """
    u = factor.copy()
    r = u.shape[1]
    eps = np.finfo(float).eps
    for _ in range(SWEEPS):
        rotated = False
        for p in range(r - 1):
            for q in range(p + 1, r):
                alpha = float(u[:, p] @ u[:, p])
                beta = float(u[:, q] @ u[:, q])
                gamma = float(u[:, p] @ u[:, q])
                if gamma == 0.0 or abs(gamma) <= eps * math.sqrt(alpha * beta):
                    continue
                rotated = True
                zeta = (beta - alpha) / (2.0 * gamma)
                t = math.copysign(1.0, zeta) / (abs(zeta) + math.sqrt(1.0 + zeta * zeta))
                c = 1.0 / math.sqrt(1.0 + t * t)
                s = c * t
                up = u[:, p].copy()
                u[:, p] = c * up - s * u[:, q]
                u[:, q] = s * up + c * u[:, q]
        if not rotated:
            break
    norms = np.sqrt((u * u).sum(axis=0))
    keep = norms > 0
    values, columns = norms[keep] ** 2, u[:, keep] / norms[keep]
    order = np.argsort(-values, kind="stable")
    return values[order], columns[:, order]


def components(n: int, sums: list[int], scatter: dict[tuple[int, int], int], dim: int):
    """(eigenvalues, unit components as rows, trace) of the exact covariance."""
    exact = [[0] * dim for _ in range(dim)]
    for i in range(dim):
        for j in range(i, dim):
            exact[i][j] = exact[j][i] = n * scatter[(i, j)] - sums[i] * sums[j]
    square = n * n
    v = np.array([[exact[i][j] / square for j in range(dim)] for i in range(dim)], dtype=np.float64)
    trace = sum(exact[i][i] for i in range(dim)) / square
    factor, order = pivoted_cholesky(v)
    values, columns = one_sided_jacobi(factor)
    vectors = np.zeros((len(values), dim))
    vectors[:, order] = columns.T
    for k in range(len(values)):
        top = int(np.argmax(np.abs(vectors[k])))
        if vectors[k, top] < 0:
            vectors[k] = -vectors[k]
    return values[:COMPONENTS], vectors[:COMPONENTS], trace


def centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list]:
    """(n x - S as float64, exact deviation or None per row)."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) * n + max(abs(s) for s in sums) < (1 << 62):
        scaled = y * np.int64(n) - np.array(sums, dtype=np.int64)
        top = int(np.abs(scaled).max(initial=0))
        if top * top * max(1, y.shape[1]) < (1 << 63):
            deviation = [int(v) for v in (scaled * scaled).sum(axis=1)]
        else:
            deviation = [int(v) for v in (scaled.astype(object) ** 2).sum(axis=1)]
        return scaled.astype(np.float64), [d if d <= LONG_MAX else None for d in deviation]
    scaled = y.astype(object) * n - np.array(sums, dtype=object)
    deviation = [int(v) for v in (scaled**2).sum(axis=1)]
    return scaled.astype(np.float64), [d if d <= LONG_MAX else None for d in deviation]


def project(fits: dict):
    """A mapInArrow function: whitened values of every row and component."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                fit = fits.get(int(dim))
                if fit is None:
                    continue
                part = batch.filter(pa.array(dims == dim))
                scaled, deviation = centred(rows_of(part, int(dim)), fit["n"], fit["sums"])
                white = (scaled / fit["n"]) @ fit["vectors"].T / np.sqrt(fit["values"])
                k = white.shape[1]
                rows = part.num_rows
                ids = part.column("vec_id").to_pylist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": pa.array([i for i in ids for _ in range(k)], pa.int64()),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        "n": pa.array(np.full(rows * k, fit["n"], dtype=np.int64)),
                        "deviation": pa.array([d for d in deviation for _ in range(k)], pa.int64()),
                        "whitened": pa.array(white.ravel()),
                        "explained": pa.array(np.tile(fit["values"] / fit["trace"], rows)),
                        "dim": pa.array(np.full(rows * k, dim, dtype=np.int32)),
                    }
                )

    return run


def whitened_pairs(fits: dict):
    """A mapInArrow function: a task's sums of w and w w^T, a row per cell."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                fit = fits.get(int(dim))
                if fit is None:
                    continue
                part = batch.filter(pa.array(dims == dim))
                scaled, _ = centred(rows_of(part, int(dim)), fit["n"], fit["sums"])
                white = (scaled / fit["n"]) @ fit["vectors"].T / np.sqrt(fit["values"])
                sums, products = white.sum(axis=0), white.T @ white
                old = held.get(int(dim))
                held[int(dim)] = [sums, products] if old is None else [old[0] + sums, old[1] + products]
        for dim, (sums, products) in held.items():
            k = len(sums)
            cells = [(i, -1, sums[i]) for i in range(k)] + [(i, j, products[i, j]) for i in range(k) for j in range(k)]
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim] * len(cells), pa.int32()),
                    "i": pa.array([c[0] for c in cells], pa.int32()),
                    "j": pa.array([c[1] for c in cells], pa.int32()),
                    "value": pa.array([float(c[2]) for c in cells], pa.float64()),
                }
            )

    return run


def fit(rows: DataFrame) -> dict:
    """Components of every vector length of ``rows`` (as ``usable`` gives them)."""
    cells = (
        rows.mapInArrow(moments, MOMENT_SCHEMA)
        .repartition("dim", "i", "j")
        .mapInArrow(add_cells, MOMENT_SCHEMA)
        .collect()
    )
    by_dim: dict[int, dict] = {}
    for cell in cells:
        by_dim.setdefault(cell.dim, {})[(cell.i, cell.j)] = int(cell.value)
    fits = {}
    for dim, sums in by_dim.items():
        n = sums[(-1, -1)]
        if dim == 0 or n < 2:
            continue
        values, vectors, trace = components(n, [sums[(i, -1)] for i in range(dim)], sums, dim)
        if len(values):
            fits[dim] = {"n": n, "sums": [sums[(i, -1)] for i in range(dim)], "values": values, "vectors": vectors, "trace": trace}
    return fits


def identity_errors(rows: DataFrame, fits: dict) -> dict[int, float]:
    """Largest |cov(w) - I| of each length, measured on the whitened rows."""
    cells = rows.mapInArrow(whitened_pairs(fits), PAIR_SCHEMA).groupBy("dim", "i", "j").agg(
        F.sum("value").alias("value")
    ).collect()
    errors = {}
    for dim, fit in fits.items():
        k, n = len(fit["values"]), fit["n"]
        mine = {(c.i, c.j): c.value for c in cells if c.dim == dim}
        mean = np.array([mine.get((i, -1), 0.0) / n for i in range(k)])
        cov = np.array([[mine.get((i, j), 0.0) / n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
        errors[dim] = float(np.abs(cov - np.eye(k)).max())
    return errors


OUT_SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, dim int"
)


def whiten(vectors: DataFrame) -> DataFrame:
    """Whitened components of every usable row, as the module states."""
    rows = usable(vectors)
    fits = fit(rows)
    errors = identity_errors(rows, fits) if fits else {}
    out = rows.mapInArrow(project(fits), OUT_SCHEMA)
    error = F.lit(None).cast("double")
    for dim, value in errors.items():
        error = F.when(F.col("dim") == dim, F.lit(value)).otherwise(error)
    return out.select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", error.alias("identity_error")
    )
