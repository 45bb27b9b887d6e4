"""Embedding whitening: principal components of all vectors, scaled to variance one.

Entries become whole numbers, ``floor(SCALE * c) + SHIFT``, so counts and sums are exact whatever the order of the rows. The
covariance is summed in tasks over blocks of centred vectors (each entry less its mean, from ``n * x - S`` in whole
numbers) and its rows are added up by Spark, first those of some tasks and then all. A matrix of the vectors'
length squared is all that reaches the driver. There Householder reflections make it tridiagonal, Sturm counts
bracket the leading eigenvalues by bisection, and inverse iteration gives their vectors; those of close eigenvalues are
made orthogonal to each other at each step. The components go to all tasks, which project the vectors; the covariance of
what they give is then checked against the identity.

Nulls and edges: a vector that is null or holds a null or a value that is not finite has no rows and no influence. A shorter vector
counts as if it ended in zeros. Entries beyond 2^50 after scaling count as 2^50. Null and repeated ids are kept, a row is a
vector of its own. A component without variance (equal vectors, one vector, dimensions that depend on others) has null
``whitened`` and is left out of the check. ``deviation`` is null where it does not fit a long. Vectors without entries
have no components; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa.llm.common import scratch, shipped, small_batches

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
LARGEST = float(1 << 50)
#: Groups of tasks whose results are added up before all are.
SALT = 64
#: Eigenvalues closer than this part of the norm are a cluster; a smaller part of the largest is no variance.
CLOSE, NOTHING = 1e-3, 1e-13
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """What was fitted: number of vectors, sum of each dimension, components (columns), their variances, all variance."""
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def has_variance(self) -> np.ndarray:
        return self.variances > NOTHING * max(self.variances.max(initial=0.0), 0.0)


# --- leading eigenvectors of a symmetric matrix ------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder's reduction: diagonal, off-diagonal, and the reflections that lead there."""
    a, n, mirrors = matrix.copy(), len(matrix), []
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 1):
        x = a[k + 1:, k].copy()
        off[k] = x[0]
        v = np.zeros_like(x)
        if np.any(x[1:]):
            off[k] = -np.copysign(np.linalg.norm(x), x[0])
            v = x
            v[0] -= off[k]
            v = v / np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = 2 * (rest @ v)
            w = p - (v @ p) * v
            rest -= np.outer(v, w) + np.outer(w, v)
        mirrors.append(v)
    return np.diag(a).copy(), off, mirrors


def smaller(d: np.ndarray, e: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each ``x``."""
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int, norm: float) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    low, high = np.full(k, -1.01 * norm), np.full(k, 1.01 * norm)
    rank = len(d) - np.arange(k)
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        under = smaller(d, e, middle, norm * EPS * EPS) < rank
        low, high = np.where(open_ & under, middle, low), np.where(open_ & ~under, middle, high)


def solved(d: np.ndarray, e: np.ndarray, x: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """y with (T - x) y = right, by elimination with exchange of rows; pivots are kept away from zero."""
    n = len(d)
    main, up, up2, y = (d - x).tolist(), [*e.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        down = float(e[i])
        if abs(main[i]) >= abs(down):
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            f = down / main[i]
            main[i + 1] -= f * up[i]
            y[i + 1] -= f * y[i]
        else:
            f = main[i] / down
            main[i], main[i + 1], up[i] = down, up[i] - f * main[i + 1], main[i + 1]
            up2[i], up[i + 1] = up[i + 1], -f * up[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
    for i in range(n - 1, -1, -1):
        rest = y[i] - (up[i] * y[i + 1] if i + 1 < n else 0.0) - (up2[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = rest / (main[i] if abs(main[i]) > tiny else tiny)
    return np.array(y)


def orthogonal(y: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``y`` without its parts along ``others``, of length one. Twice, as the first time leaves rounding errors."""
    for _ in range(2):
        for z in others:
            y = y - (z @ y) * z
        y = y / np.linalg.norm(y)
    return y


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    k = min(k, len(matrix))
    if not np.any(matrix):
        return np.zeros(k), np.eye(len(matrix), k)
    d, e, mirrors = tridiagonal(matrix)
    norm = float(max(np.abs(d) + np.concatenate([np.abs(e), [0.0]]) + np.concatenate([[0.0], np.abs(e)])))
    values, found, start = leading_values(d, e, k, norm), [], 0
    rng = np.random.default_rng(11)
    x = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            start = j  # a new cluster
        x = min(float(value), x - 10 * EPS * norm)
        y = rng.uniform(-1, 1, len(d))
        y /= np.linalg.norm(y)
        for _ in range(5):
            y = solved(d, e, x, y, EPS * norm)
            y = orthogonal(y / np.abs(y).max(), found[start:])
        found.append(y)
    out = []
    for y in found:
        z = y.copy()
        for i in range(len(mirrors) - 1, -1, -1):
            z[i + 1:] -= 2 * (mirrors[i] @ z[i + 1:]) * mirrors[i]
        out.append(orthogonal(z, out))
    vectors = np.array(out).T
    return np.einsum("ij,ij->j", vectors, matrix @ vectors), vectors


# --- over all vectors ---------------------------------------------------------------------------

def usable(vectors: DataFrame, column: str, *ids: str) -> DataFrame:
    """The rows whose vector is there and finite, with entries as doubles in ``c``."""
    c = F.col(column).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return small_batches(vectors.where(F.col(column).isNotNull() & finite).select(*ids, c.alias("c")))


def whole(vectors: pd.Series, dims: int | None, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers, a row for each vector, and which of them are entries it has."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    width = int(sizes.max(initial=0)) if dims is None else dims
    out = np.zeros((len(vectors), width))
    mine = np.arange(width) < sizes[:, None]
    out[mine] = np.concatenate([np.asarray(v, float) for v in vectors]) if len(vectors) else []
    return np.clip(np.floor(out * scale), -LARGEST, LARGEST).astype(np.int64) + shift, mine


def sums_of(rows: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held = 0, {}
        for batch in batches:
            x, mine = whole(batch["c"], None, scale, shift)
            n += len(x)
            for i, (s, c) in enumerate(zip((x * mine).sum(axis=0).tolist(), mine.sum(axis=0).tolist(), strict=True)):
                old = held.get(i, (0, 0))
                held[i] = (old[0] + s, old[1] + c)
        held[-1] = (0, n)
        yield pd.DataFrame({"dim": list(held), "total": [str(s) for s, _ in held.values()], "n": [c for _, c in held.values()]})

    found = rows.select("c").mapInPandas(run, "dim int, total string, n long").groupBy("dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    by_dim = {r["dim"]: (int(r["total"]), r["n"]) for r in found.toLocalIterator()}
    n = by_dim.pop(-1, (0, 0))[1]
    return n, [by_dim[i][0] + shift * (n - by_dim[i][1]) for i in range(len(by_dim))]


def apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` in whole numbers; Python's own where 64 bits are too few."""
    small = n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61
    kind = np.int64 if small else object
    return x.astype(kind) * n - np.array(sums, kind)


def covariance(rows: DataFrame, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """Divisor ``n``; vectors are centred before they are multiplied."""
    dims = len(sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            centred = (apart(whole(batch["c"], dims, scale, shift)[0], n, sums) / n).astype(float)
            total += centred.T @ centred
        salt = TaskContext.get().partitionId() % SALT
        for a in range(0, dims, 256):
            part = range(a, min(a + 256, dims))
            yield pd.DataFrame({"i": part, "salt": salt, "row": [total[i].tobytes() for i in part]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(dims)
        for row in pdf["row"]:
            total += np.frombuffer(row)
        return pdf.iloc[:1].assign(row=[total.tobytes()])

    shape = "i int, salt int, row binary"
    parts = rows.select("c").mapInPandas(run, shape).groupBy("i", "salt").applyInPandas(added, shape).groupBy("i").applyInPandas(added, shape)
    out = np.zeros((dims, dims))
    for r in parts.toLocalIterator():
        out[r["i"]] = np.frombuffer(r["row"])
    return (out + out.T) / (2 * n)


def fit(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> Whitening:
    """Components of all usable vectors."""
    rows = usable(vectors, column)
    n, sums = sums_of(rows, scale, shift)
    if not sums:
        return Whitening(n, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    matrix = covariance(rows, n, sums, scale, shift)
    values, components = leading(matrix, k)
    return Whitening(n, sums, components, np.maximum(values, 0.0), float(np.trace(matrix)))


def squares(d: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None beyond a long."""
    if d.dtype == object or np.abs(d).max(initial=0) >= 1 << 50:
        sums = [sum(int(v) ** 2 for v in row) for row in d]
    else:
        high, low = d >> 25, d & ((1 << 25) - 1)
        parts = [(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))]
        sums = [(a << 50) + (b << 26) + c for a, b, c in zip(*parts, strict=True)]
    return [s if s < 1 << 63 else None for s in sums]


def project(vectors: DataFrame, fitted: Whitening, column: str = "embedding", key: str = "vec_id", scale: float = SCALE,
            shift: int = SHIFT) -> DataFrame:
    """key, deviation, w: the whitened components of every usable vector (null for those without variance)."""
    rows = usable(vectors, column, key)
    n, sums, dims, good = fitted.n, fitted.sums, len(fitted.sums), fitted.has_variance()
    onto = np.where(good, fitted.components / np.sqrt(np.where(good, fitted.variances, 1.0)), 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = apart(whole(batch["c"], dims, scale, shift)[0], n, sums)
            w = (d / n).astype(float) @ onto
            yield pd.DataFrame({key: batch[key], "deviation": pd.array(squares(d), "Int64"),
                                "w": [[v if g else None for v, g in zip(row, good, strict=True)] for row in w.tolist()]})

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(projected: DataFrame, fitted: Whitening) -> float | None:
    """Largest absolute entry of the covariance of ``w`` less the identity; null if no component has variance."""
    good = np.flatnonzero(fitted.has_variance()).tolist()
    if not good:
        return None
    w = {i: F.col("w")[i] for i in good}
    means = projected.agg(*[F.avg(w[i]).alias(f"m{i}") for i in good]).first()
    products = [F.avg((w[i] - F.lit(means[f"m{i}"])) * (w[j] - F.lit(means[f"m{j}"]))) - F.lit(float(i == j)) for i in good for j in good if j <= i]
    return max(abs(v) for v in projected.agg(*[p.alias(f"p{i}") for i, p in enumerate(products)]).first())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", k: int = COMPONENTS, scale: float = SCALE,
           shift: int = SHIFT) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    spark = vectors.sparkSession
    fitted = fit(vectors, column, k, scale, shift)
    folder = scratch(spark, "whitened")
    project(vectors, fitted, column, key, scale, shift).write.parquet(folder)
    projected = spark.read.parquet(folder)
    error = identity_error(projected, fitted) if fitted.n else None
    shares = F.array(*[F.lit(float(v / fitted.trace) if fitted.trace else 0.0) for v in fitted.variances]).cast("array<double>")
    return projected.select(key, "deviation", F.posexplode("w").alias("_at", "whitened")).select(
        key, (F.col("_at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


shipped(__name__)
