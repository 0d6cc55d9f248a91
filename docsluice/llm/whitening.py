"""Operator 13: whitening of embeddings by their leading principal components.

Components become whole numbers, so sums are exact and the same in every order of tasks. Each distinct vector counts once. Tasks centre the
vectors by the rounded means before they multiply, and sum the products as integers; what rounding the means leaves is taken off exactly, and
each entry of the covariance is rounded once. The covariance, d by d for d dimensions, goes to the driver, where it is made tridiagonal by
Householder reflections; Sturm counts bisect for the leading eigenvalues, and inverse iteration gives their vectors, orthogonalised
again within clusters. Tasks then project all rows by the broadcast components, and once more the distinct vectors to measure how far
the whitened covariance is from the identity.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, read, save
from .vectors import fixed_point, matrix, usable

EPS = np.finfo(float).eps
#: Largest sum that doubles hold exactly, and the largest that longs may reach before they are handed on.
DOUBLES, LONGS = 1 << 53, 1 << 62


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix made tridiagonal by reflections H = I - 2 u u'."""
    a, n, done = a.astype(float).copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        if not np.any(x[1:]):
            continue
        u = x / np.abs(x).max()
        u[0] += math.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        p = a[k + 1 :, k + 1 :] @ u
        p -= (u @ p) * u
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, p) + np.outer(p, u))
        alpha = x - 2 * u * (u @ x)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = alpha[0]
        done.append((k + 1, u))
    return a.diagonal().copy(), a.diagonal(-1).copy(), done


def sturm_count(d: np.ndarray, e: np.ndarray, x: float, least: float) -> int:
    """How many eigenvalues of the tridiagonal matrix are below x: negative pivots of T - x I."""
    count, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < least:
            q = -least
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, each bisected until its interval has no double inside."""
    n = len(d)
    radius = np.abs(np.r_[e, 0.0]) + np.abs(np.r_[0.0, e])
    lo, hi = float((d - radius).min()), float((d + radius).max())
    size = max(abs(lo), abs(hi))
    least = max(EPS * EPS * size, np.finfo(float).tiny)
    lo, hi = lo - EPS * n * size - least, hi + EPS * n * size + least
    out: list[float] = []
    for j in range(min(k, n)):
        a, b = lo, out[-1] if out else hi  # j + 1 eigenvalues are at or above the one sought
        if out and n - sturm_count(d, e, b, least) > j:
            out.append(b)  # as often as it is an eigenvalue
            continue
        while True:
            m = a + (b - a) / 2
            if not a < m < b:
                break
            a, b = (m, b) if n - sturm_count(d, e, m, least) > j else (a, m)
        out.append(a)
    return out


def solve_shifted(d: np.ndarray, e: np.ndarray, x: float, rhs: np.ndarray, least: float) -> np.ndarray:
    """(T - x I) y = rhs by elimination with row exchanges; pivots of zero become `least`."""
    n, y = len(d), rhs.copy()
    a, b, c = d - x, np.r_[e, 0.0], np.zeros(n)  # pivots, first and second place to the right
    low = e.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(a[i]):
            a[i], low[i] = low[i], a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = b[i + 1], c[i]
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(a[i]) < least:
            a[i] = least
        f = low[i] / a[i]
        a[i + 1] -= f * b[i]
        b[i + 1] -= f * c[i]
        y[i + 1] -= f * y[i]
    if abs(a[-1]) < least:
        a[-1] = least
    for i in range(n - 1, -1, -1):
        y[i] = (y[i] - (b[i] * y[i + 1] if i + 1 < n else 0.0) - (c[i] * y[i + 2] if i + 2 < n else 0.0)) / a[i]
        if abs(y[i]) > 1e200:
            y *= 1e-200
    return y


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors (columns) of the eigenvalues. Vectors of a cluster, whose values differ by less than a thousandth of the
    matrix's size, are orthogonalised against each other in every step, twice."""
    n, size = len(d), max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    draw, out = np.random.default_rng(n), np.zeros((n, len(values)))
    for j, x in enumerate(values):
        near = [i for i in range(j) if abs(values[i] - x) <= 1e-3 * size]
        y = draw.standard_normal(n)
        for _ in range(4):
            y = solve_shifted(d, e, x + EPS * size * (j - near[0] if near else 0), y / np.abs(y).max(), EPS * size)
            y /= np.linalg.norm(y)
            for _ in range(2):
                for i in near:
                    y -= (out[:, i] @ y) * out[:, i]
                y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def principal(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance: up to k, those above what rounding makes of zero."""
    trace = float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    d, e, done = householder(v / trace)
    values = [x for x in leading_eigenvalues(d, e, k) if x > 8 * len(v) * EPS]
    y = inverse_iteration(d, e, values)
    for at, u in reversed(done):
        y[at:] -= 2 * np.outer(u, u @ y[at:])
    return np.array(values) * trace, y


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exactly: in doubles, longs or Python's integers, whichever holds it."""
    most = int(np.abs(y).max(initial=0)) ** 2 * max(1, len(y))
    if most < DOUBLES:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64)
    z = y if most < LONGS else y.astype(object)
    return z.T @ z


def _sums(dim: int):
    """A task's sums of each component; place dim has the number of rows."""

    def run(batches):
        total = np.zeros(dim + 1, object)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["x"], dim, np.int64)
                x = x if max(int(x.max()), -int(x.min())) * len(x) < LONGS else x.astype(object)
                total += np.append(x.sum(axis=0).astype(object), len(x))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim + 1), pa.int32()), "s": pa.array([str(v) for v in total])})

    return run


def _products(dim: int, centre: list[int]):
    """A task's sums of products of centred vectors: (i, j, sum) with i <= j; j = dim has the sums of the vectors themselves."""

    def run(batches):
        total = np.zeros((dim + 1, dim + 1), object)
        held, size = np.zeros((dim + 1, dim + 1), np.int64), 0
        mid = np.array(centre, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"], dim, np.int64)
            reach = max(int(x.max()) - min(centre), max(centre) - int(x.min()), 1)
            y = x - mid if reach < LONGS else x.astype(object) - mid.astype(object)
            part = exact_products(np.concatenate([y, np.ones((len(y), 1), y.dtype)], axis=1))
            size += reach**2 * len(y)
            if part.dtype == object or size >= LONGS:
                total, held, size = total + held + part, np.zeros_like(held), 0
            else:
                held += part
        total = total + held
        i, j = np.triu_indices(dim + 1)
        if np.any(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": pa.array([str(v) for v in total[i, j]])})

    return run


def covariance(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) of a saved table of distinct vectors x."""
    exact = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    total = {r["i"]: int(r["s"]) for r in fit.mapInArrow(_sums(dim), "i int, s string").groupBy("i").agg(exact).collect()}
    n, sums = total.get(dim, 0), [total.get(i, 0) for i in range(dim)]
    if not n or not dim:
        return 0, sums, np.zeros((dim, dim))
    centre = [round(Fraction(s, n)) for s in sums]
    parts = fit.mapInArrow(_products(dim, centre), "i int, j int, s string").groupBy("i", "j").agg(exact)
    s = {(r["i"], r["j"]): int(r["s"]) for r in parts.collect()}  # d * d / 2 numbers, whatever the rows
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            # the mean of the centred values, below one half, is taken off in whole numbers
            v[i, j] = v[j, i] = Fraction(n * s[i, j] - s[i, dim] * s[j, dim], n * n)
    return n, sums, v


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double: whole parts are taken off first, so large means lose nothing."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole).astype(float) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the components of (n x - sums) ** 2 of each row, exactly; null where it does not fit a long."""
    most = (n * max(int(x.max()), -int(x.min()), 1) + max(map(abs, sums))) ** 2 * x.shape[1]
    off = (x if most < LONGS else x.astype(object)) * n - np.array(sums, np.int64 if most < LONGS else object)
    return pa.array([v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()], pa.int64())


def _whiten(model):
    def run(batches):
        dim, n, sums, values, vectors, explained, error = model.value
        k = len(values)
        scale = vectors / np.sqrt(values)
        for batch in batches:
            m = batch.num_rows
            if m:
                x = matrix(batch["x"], dim, np.int64)
                w = _offsets(x, n, sums) @ scale
                again = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": batch["id"].take(pa.array(again)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": np.full(m * k, n), "deviation": deviations(x, n, sums).take(pa.array(again)),
                        "whitened": w.ravel(), "explained": np.tile(explained, m), "identity_error": np.full(m * k, error),
                    }
                )

    return run


def _second_moments(model):
    """A task's sums of products of whitened values."""

    def run(batches):
        dim, n, sums, values, vectors = model.value
        scale, total = vectors / np.sqrt(values), np.zeros((len(values), len(values)))
        for batch in batches:
            if batch.num_rows:
                w = _offsets(matrix(batch["x"], dim, np.int64), n, sums) @ scale
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each row that takes part and each component.

    Rows whose vector is null, empty, holds null or non-finite components or ones that do not fit a long when scaled take no part, nor do
    rows of another length than the most frequent (of equally frequent ones, the longest). Repeated rows are repeated in the result, but count once in
    the fit; a null id stays null. Components whose eigenvalue is zero but for rounding are left out, so a table of one distinct vector or of none gives
    no rows. deviation is null where it does not fit a long.
    """
    spark, v = df.sparkSession, F.col(vector_col)
    rows = df.where(usable(v)).select(F.col(id_col).alias("id"), fixed_point(v, scale).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = lengths["d"] if lengths else 0
    rows = rows.where(F.size("x") == dim)
    fit = save(rows.select("x").distinct(), "fit")
    n, sums, cov = covariance(fit, dim)
    values, vectors = principal(cov, components)
    kind = f"vec_id {dict(df.select(id_col).dtypes)[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(values):
        return spark.createDataFrame([], kind)
    moments = fit.mapInArrow(_second_moments(spark.sparkContext.broadcast((dim, n, sums, values, vectors))), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    discard(fit)
    error = max(abs(r["s"] / n - (r["i"] == r["j"])) for r in moments)
    model = spark.sparkContext.broadcast((dim, n, sums, values, vectors, values / np.trace(cov), error))
    return rows.select("id", "x").mapInArrow(_whiten(model), kind)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four whitened components of every row of embeddings."""
    return whiten(read(spark, sf_dir, "embeddings"))
