"""Whitening of embeddings by principal components.

Entries are made whole numbers, so counts, sums and the scatter are exact. The scatter of vectors, centred at the
nearest whole number to each mean before they are multiplied, is summed by partition and put right for what is left of the mean
in exact numbers. A Cholesky factorisation with pivots gives a triangular factor (and the rank), whose columns are then rotated in
pairs until they are orthogonal (one-sided Jacobi): their norms are the square roots of the eigenvalues, and their directions
the components. Neither step forms or diagonalises another product matrix, so small eigenvalues keep their precision.

What passes through the driver is a count, sums and a matrix of the dimension of the vectors, whatever the number of rows.

Defined cases: rows whose vector is null or has null, infinite or NaN entries are left out; others stay, with a null or repeated id too.
Entries that a vector lacks against the longest count as 0. Only components with a variance are given: none if all vectors are
equal or there is one vector only. An empty table gives no rows. Numbers too large for exact 64-bit sums of a row are an error.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows of one numpy pass.
PASS_ROWS = 4096
#: A pivot below this part of the largest, times the dimension, ends the factorisation.
_EPSILON = np.finfo(float).eps


def whole_vectors(column: pa.Array, width: int | None = None):
    """(index of the rows that stay, their entries as whole numbers, how many entries each has); shorter vectors are filled up to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64())
    values = flat.to_numpy(zero_copy_only=False) if not flat.null_count else pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(column)) > 0
    stays = valid & ~bad
    width = int(lengths[stays].max(initial=0)) if width is None else width
    scaled = np.floor(values[stays[row]] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("an entry is too large for a whole number of 64 bits")
    out = np.full((int(stays.sum()), width), OFFSET, np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    new_row = np.cumsum(stays) - 1
    out[new_row[row[stays[row]]], place[stays[row]]] = scaled.astype(np.int64) + OFFSET
    return np.flatnonzero(stays), out, lengths[stays]


def _decimals(values) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _moments(vectors: DataFrame, column: str) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches):
        n, sums, counts = 0, np.zeros(0, object), np.zeros(0, np.int64)
        for batch in batches:
            _, x, lengths = whole_vectors(batch.column(0))
            n += len(x)
            if x.shape[1] > len(sums):
                more = x.shape[1] - len(sums)
                sums, counts = np.concatenate([sums, np.zeros(more, object)]), np.concatenate([counts, np.zeros(more, np.int64)])
            for i in range(x.shape[1]):
                has = lengths > i
                part = x[has, i]
                sums[i] += int(part.sum()) if not len(part) or int(np.abs(part).max()) < 2**62 // len(part) else sum(part.tolist())
                counts[i] += int(has.sum())
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([n, *counts.tolist()], pa.int64()), _decimals([0, *sums])], names=["i", "n", "s"])

    bound_batches(vectors.sparkSession)
    parts = vectors.select(column).mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = {r["i"]: (r["n"], int(r["s"])) for r in parts.collect()}  # a row for each dimension
    n = found.pop(-1, (0, 0))[0]
    return n, [found[i][1] + (n - found[i][0]) * OFFSET for i in range(len(found))]


def _scatter(vectors: DataFrame, column: str, centre: np.ndarray) -> np.ndarray:
    """Exact sums of the products of all pairs of dimensions of vectors less a centre of whole numbers, as an array of Python integers."""
    width = len(centre)
    upper = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width), object)
        for batch in batches:
            _, x, _ = whole_vectors(batch.column(0), width)
            for a in range(0, len(x), PASS_ROWS):
                z = x[a : a + PASS_ROWS] - centre
                if int(np.abs(z).max(initial=0)) < 1 << 20:  # sums of products stay below 2^53, where doubles are exact
                    d = z.astype(np.float64)
                    total += (d.T @ d).astype(np.int64)
                else:
                    total += z.astype(object).T @ z.astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _decimals(total[upper])], names=["i", "j", "s"])

    parts = vectors.select(column).mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width), object)
    for r in parts.collect():  # a row for each pair of dimensions
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["s"])
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with L L' = v, of as many columns as v has rank; rows are in the order of v, and the factor is lower triangular in the order of the pivots."""
    d = len(v)
    left, rest, columns = v.astype(np.float64).copy(), np.ones(d, bool), []
    least = d * _EPSILON * max(left.diagonal().max(initial=0), 0)
    for _ in range(d):
        diagonal = np.where(rest, left.diagonal(), -np.inf)
        p = int(np.argmax(diagonal))
        if not diagonal[p] > least:
            break
        column = np.where(rest, left[:, p], 0.0) / np.sqrt(left[p, p])
        columns.append(column)
        rest[p] = False
        left -= np.outer(column, column)
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def one_sided_jacobi(factor: np.ndarray, tolerance: float = 1e-15, most_sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated in pairs until all are orthogonal.

    A sweep meets every pair once, in rounds of pairs that have no column in common, so a round is one array operation.
    """
    a = factor.astype(np.float64).copy()
    r = a.shape[1]
    seats = list(range(r)) + ([-1] if r % 2 else [])
    for _ in range(most_sweeps):
        worst = 0.0
        for _ in range(max(0, len(seats) - 1)):
            half = len(seats) // 2
            pairs = [(i, j) for i, j in zip(seats[:half], reversed(seats[half:])) if i >= 0 and j >= 0]
            if not pairs:  # one column only
                continue
            i, j = (np.array(x) for x in zip(*pairs))
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            cosine = np.abs(xy) / np.where(size > 0, size, 1)
            worst = max(worst, float(cosine.max()))
            turn = cosine > tolerance
            zeta = (yy - xx) / (2 * np.where(turn, xy, 1))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= tolerance * 8:
            break
    return a


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a positive semidefinite matrix, by falling eigenvalue, as many as it has rank; the largest entry of each vector is positive."""
    rotated = one_sided_jacobi(pivoted_cholesky(v))
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    vectors = rotated[:, order] / norms[order]
    if vectors.shape[1]:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return norms[order] ** 2, vectors


class Whitening:
    """Fitted components: the count and sums of the vectors, eigenvalues and eigenvectors, and the trace of the covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        whole = [s // n if n else 0 for s in sums]
        self.whole = np.array(whole, np.int64)
        self.part = np.array([float(Fraction(s - w * n, n)) for s, w in zip(sums, whole)]) if n else np.zeros(0)

    def project(self, x: np.ndarray, most: int) -> np.ndarray:
        """Whitened coordinates of whole-number vectors: the centred vector on each component, over the root of its eigenvalue."""
        centred = (x - self.whole).astype(np.float64) - self.part
        k = min(most, len(self.values))
        return centred @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening:
    """Components of the covariance (divisor n) of all vectors."""
    n, sums = _moments(vectors, column)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    scatter = _scatter(vectors, column, np.array(centre, np.int64))
    left = [s - c * n for s, c in zip(sums, centre)]
    v = np.array([[float(Fraction(int(scatter[i, j]) * n - left[i] * left[j], n * n)) for j in range(len(sums))] for i in range(len(sums))], float).reshape(len(sums), len(sums))
    values, found = components(v)
    return Whitening(n, sums, values, found, float(v.trace()))


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding", most: int = COMPONENTS) -> float:
    """The largest absolute entry of the covariance of all whitened vectors less the identity; measured over the vectors, not derived."""
    k = min(most, len(model.values))
    if not k:
        return 0.0
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, x, _ = whole_vectors(batch.column(0), len(shared.value.sums))
            for a in range(0, len(x), PASS_ROWS):
                w = shared.value.project(x[a : a + PASS_ROWS], k)
                first += w.sum(axis=0)
                second += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        rows = [np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j]), np.concatenate([first, second.reshape(-1)])]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2])], names=["i", "j", "s"])

    parts = vectors.select(column).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # k rows and a row for each pair
    mean, second = np.zeros(k), np.zeros((k, k))
    for r in parts:
        if r["i"] < 0:
            mean[r["j"]] = r["s"] / model.n
        else:
            second[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """For each vector and component up to ``most``: ``key``, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum over the dimensions of (n * x - S)^2, S being the sum of the dimension.
    """
    model = fit(vectors, column)
    error = identity_error(vectors, model, column, most)
    k = min(most, len(model.values))
    explained = [float(e / model.trace) for e in model.values[:k]]
    shared = vectors.sparkSession.sparkContext.broadcast((model, explained))

    def run(batches):
        model, explained = shared.value
        for batch in batches:
            stays, x, _ = whole_vectors(batch.column(1), len(model.sums))
            for a in range(0, len(x), PASS_ROWS):
                part, m = x[a : a + PASS_ROWS], len(x[a : a + PASS_ROWS])
                ids = batch.column(0).take(pa.array(stays[a : a + m]))
                w = model.project(part, k)
                columns = [ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                           pa.array(np.repeat(_deviations(part, model), k)), pa.array(w.reshape(-1)), pa.array(np.tile(np.array(explained), m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[key].dataType.simpleString()
    bound_batches(vectors.sparkSession)
    out = vectors.select(F.col(key).alias("key"), column).mapInArrow(run, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)


def _deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Exact sums of squares of n * x - S; by 64-bit numbers where they hold, else by longer ones, and an error where the sum itself is longer."""
    n, width = model.n, max(1, x.shape[1])
    shift = [s - n * int(w) for s, w in zip(model.sums, model.whole)]  # n * x - S is n * (x - whole) - shift
    z = x - model.whole
    most = n * int(np.abs(z).max(initial=0)) + n
    if most * most * width < 2**63:
        y = z * n - np.array(shift, np.int64)
        return (y * y).sum(axis=1)
    y = z.astype(object) * n - np.array(shift, object)
    out = (y * y).sum(axis=1)
    if max(out, default=0) >= 2**63:
        raise OverflowError("a sum of squares is too large for 64 bits")
    return out.astype(np.int64)
