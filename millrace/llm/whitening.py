"""PCA whitening of embeddings.

Two distributed passes give the covariance: exact sums, then centred products.  Its leading eigenpairs are found on the
driver from the small matrix alone: Householder reflections make it tridiagonal, bisection on Sturm counts gives
the eigenvalues, inverse iteration the vectors, those of close eigenvalues being made orthogonal to one another.
Mean, vectors and scales are broadcast, and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, frame, fresh, materialize

COMPONENTS = 32
#: An entry c becomes floor(STEP * c) + SHIFT.
STEP, SHIFT = 64, 1_000_000
#: No entry is larger in size.
MOST = 2.0**30
#: Eigenvalues at most this share of the largest, times the dimension, are zero: nothing can be scaled by them.
ZERO = 4 * np.finfo(float).eps
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLOSE = 1e-3


# --- eigenpairs of a symmetric matrix --------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with Q' matrix Q tridiagonal, by Householder reflections."""
    a, d = np.array(matrix, dtype=float), len(matrix)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        if not (length := np.linalg.norm(x)):
            continue
        v = x / length
        block = a[k + 1 :, k + 1 :]
        w = block @ v
        w -= (v @ w) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of the values `at`: negative pivots of the shifted matrix."""
    least = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.max(off**2, initial=0)))
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(int)
    for value, square in zip(diagonal[1:], off**2, strict=True):
        pivot = value - at - square / np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, each bisected until no double lies between its bounds."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    slack = 2 * np.finfo(float).eps * d * np.max(np.abs(diagonal) + reach) + np.finfo(float).tiny
    low = np.full(count, np.min(diagonal - reach) - slack)
    high = np.full(count, np.max(diagonal + reach) + slack)
    rank = d - 1 - np.arange(count)  # of the eigenvalue, from the smallest
    while True:
        middle = low + (high - low) / 2
        if not np.any(moving := (middle > low) & (middle < high)):
            return middle
        over = sturm_counts(diagonal, off, middle) > rank
        high = np.where(moving & over, middle, high)
        low = np.where(moving & ~over, middle, low)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = right, by elimination with row exchanges; vanishing pivots become `least`."""
    d = len(diagonal)
    main, up, far, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    for i in range(d - 1):
        low = off[i]
        if abs(low) > abs(main[i]):  # rows i and i + 1 change places
            ratio = main[i] / low
            main[i], main[i + 1], up[i] = low, up[i] - ratio * main[i + 1], main[i + 1]
            far[i], up[i + 1] = up[i + 1], -ratio * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - ratio * x[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > least else least
            ratio = low / main[i]
            main[i + 1] -= ratio * up[i]
            x[i + 1] -= ratio * x[i]
    main[-1] = main[-1] if abs(main[-1]) > least else least
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < d else 0) - (far[i] * x[i + 2] if i + 2 < d else 0)) / main[i]
    return x / np.max(np.abs(x))


def eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the `count` largest eigenvalues of a symmetric matrix, falling."""
    diagonal, off, q = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, count)
    norm = float(np.max(np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off)))) or 1.0
    eps = np.finfo(float).eps
    draw, vectors, first, shift = np.random.default_rng(11), np.zeros((len(diagonal), count)), 0, np.inf
    for k, value in enumerate(values):
        first = first if k and values[k - 1] - value < CLOSE * norm else k
        # equal eigenvalues are told apart by a hair, so that each solve has a direction of its own
        shift = min(value, shift - 10 * eps * norm) if first < k else value
        x = draw.standard_normal(len(diagonal))
        for _ in range(6):
            x = solve_shifted(diagonal, off, shift, x, eps * norm)
            for _ in range(2):  # once more, for what rounding leaves
                x -= vectors[:, first:k] @ (vectors[:, first:k].T @ x)
                x /= np.linalg.norm(x)
        vectors[:, k] = x
    return values, q @ vectors


# --- the distributed part --------------------------------------------------------------------------------


def fit_list(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x): the remaining vectors as integers.

    Null vectors and those with null or non-finite entries go.  All that remain must have one length; where they have not,
    the length that most have (of equally many the greater) is the list's, and the others go too.  Entries beyond MOST count
    as MOST, so that no sum leaves its type.
    """
    values = F.col(f"`{column}`")
    finite = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(values.isNotNull() & finite & (F.size(values) > 0))
    lengths = kept.groupBy(F.size(values).alias("d")).agg(F.count("*").alias("rows")).collect()  # a row for each length
    if not lengths:
        return kept.select(F.col(f"`{key}`").alias(key), F.lit(None).cast("array<long>").alias("x"))
    d = max(lengths, key=lambda r: (r.rows, r.d)).d
    x = F.transform(values, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double"))) * STEP).cast("long") + SHIFT)
    return kept.where(F.size(values) == d).select(F.col(f"`{key}`").alias(key), x.alias("x"))


def _stacked(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind) if len(column) else np.zeros((0, 0), kind)


def sums(rows: DataFrame, column: str = "x") -> tuple[int, list]:
    """(n, sum of each dimension) in one pass; integers are summed exactly."""
    each = rows.select(F.posexplode(column).alias("j", "value")).groupBy("j").agg(F.count("*").alias("n"), F.sum("value").alias("s")).orderBy("j").collect()
    return (each[0].n if each else 0), [r.s for r in each]


def covariance(rows: DataFrame, column: str, mean: np.ndarray, n: int, centred) -> np.ndarray:
    """Covariance of the vectors in `column`, with divisor n.  centred(batch) gives a batch's deviations from the mean.

    A task adds up the products of its rows, centred beforehand, and gives the upper triangle once; these are summed by entry.
    """
    d = len(mean)
    upper = np.triu_indices(d)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                y = centred(np.stack(pdf[column].to_numpy()))
                total += y.T @ y
        yield frame([(total[upper],)], ["part"])

    parts = rows.select(column).mapInPandas(products, "part array<double>")
    entries = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((d, d))
    for r in entries:
        out[upper[0][r.at], upper[1][r.at]] = out[upper[1][r.at], upper[0][r.at]] = r.value / n
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(rows, summary): rows (key, deviation, whitened array) and a row (n, explained array, identity_error).

    deviation is the sum over dimensions of (n * x - S)^2, null where no long holds it.  whitened has an entry for each
    component, up to as many as dimensions; it is null where the eigenvalue is zero (fewer directions than components, as for one
    vector or all alike), and identity_error covers the others.  explained is null where the trace is zero.  Each row is
    whitened for itself: repeated rows, ties and null keys too.  No remaining vectors: no rows in either.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    listed = materialize(fit_list(vectors, column, key), "fit-list")
    n, s = sums(listed)
    if not n:
        return listed.select(key, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")), spark.createDataFrame([], "n long, explained array<double>, identity_error double")
    total = np.array(s, dtype=np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x * np.int64(n) - total) / n  # the difference is exact: n * x and S are integers

    v = covariance(listed, "x", total, n, centred)
    values, axes = eigenpairs(v, min(components, len(v)))
    usable = values > ZERO * len(v) * max(values[0], 0)
    known = spark.sparkContext.broadcast((total, np.where(usable, axes / np.sqrt(np.where(usable, values, 1)), 0.0), usable))

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sums_, scaled, live = known.value
        for part in parts:
            if not len(part):
                yield frame([], ["deviation", "whitened"])
                continue
            whole = _stacked(part, np.int64) * np.int64(n) - sums_
            near = (whole.astype(float) ** 2).sum(axis=1)
            # from 2^62 on the sum is taken in unbounded integers
            exact = [int(a) if b < 2**62 else sum(int(c) ** 2 for c in row) for a, b, row in zip((whole**2).sum(axis=1), near, whole, strict=True)]
            out = np.where(live, whole / n @ scaled, np.nan)
            yield frame([(a if a < 2**63 else None, [None if np.isnan(c) else c for c in w]) for a, w in zip(exact, out.tolist(), strict=True)], ["deviation", "whitened"])

    done = materialize(listed.select(key, project("x").alias("p")).select(key, "p.*"), "whitened")
    live = np.flatnonzero(usable)
    error = None
    if len(live):
        alive = done.select(F.transform(F.array(*[F.lit(int(i)) for i in live]), lambda i: F.get("whitened", i)).alias("w"))
        middle = np.array(sums(alive, "w")[1]) / n
        error = float(np.max(np.abs(covariance(alive, "w", middle, n, lambda w: w - middle) - np.eye(len(live)))))
    trace = float(np.trace(v))
    explained = [float(e) / trace for e in values] if trace > 0 else [None] * len(values)
    return done, spark.createDataFrame([(n, explained, error)], "n long, explained array<double>, identity_error double")


def long_form(rows: DataFrame, summary: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row for each vector and component, numbered from 1, with the summary's values."""
    at = fresh(rows, "at")
    each = rows.select(key, "deviation", F.posexplode("whitened").alias(at, "whitened"))
    joined = each.join(F.broadcast(summary))  # one row
    return joined.select(key, (F.col(at) + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col(at)).alias("explained"), "identity_error")
