"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Vectors become exact integers x = floor(64 c) + 1000000.  The fit list holds
each distinct x vector once (n vectors with sums S).  Its centred rows are
reduced to one triangular R: every task folds its rows block by block into an
R of its own, and the R's of 16 tasks at a time are folded until one is left.
Householder reflections make R bidiagonal; the differential qd algorithm with
shifts (dqds) finds the squared singular values to high relative accuracy, and
a twisted factorisation at each of them gives its vector.  Only matrices of the
dimension of the vectors (R, the components, sums) reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_path, ship_package

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
FAN_IN = 16
_EPS = np.finfo(float).eps
_LONG = (1 << 63) - 1
_SCHEMA = ("component int, n bigint, deviation bigint, whitened double, explained double, "
           "identity_error double")


# ---- the solver (matrices of the vectors' dimension)

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right): r = left . bidiagonal . right^T by
    Householder reflections from both sides; ``right`` is orthogonal."""
    a = np.array(r, dtype=float)
    d = a.shape[1]
    right = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """v with (I - v v^T) x = a multiple of the first unit vector."""
    v = x.copy()
    norm = np.linalg.norm(x)
    if norm == 0 or not np.any(x[1:]):
        return np.zeros_like(x)
    v[0] += np.copysign(norm, x[0])
    return v * (np.sqrt(2) / np.linalg.norm(v))


def _qd_step(q: list[float], e: list[float], shift: float):
    """(q, e, least d) of the qd array less ``shift``; None where the shift
    exceeds the least eigenvalue."""
    d, least = q[0] - shift, q[0] - shift
    new_q, new_e = [], []
    for i, ei in enumerate(e):
        if d < 0:
            return None
        s = d + ei
        ratio = q[i + 1] / s if s > 0 else 1.0
        new_q.append(s)
        new_e.append(ei * ratio)
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, least


def dqds(diagonal, superdiagonal) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in superdiagonal]
    found, open_ = [], [(q, e, 0.0)]
    tol = _EPS * _EPS
    while open_:
        q, e, base = open_.pop()
        shift, failures, sweeps = 0.0, 0, 0
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= tol * (base + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                if cut + 1 < len(q) - 1:
                    open_.append((q[cut + 1:], e[cut + 1:], base))
                else:
                    found.append(base + q[-1])
                q, e = q[:cut + 1], e[:cut]
                shift, failures = 0.0, 0
                continue
            if 1.5 * q[0] < q[-1]:  # the small end belongs last
                q.reverse()
                e.reverse()
            stepped = _qd_step(q, e, shift)
            if stepped is None:
                failures += 1
                shift = shift / 4 if failures < 4 else 0.0
                continue
            q, e, least = stepped
            base += shift
            sweeps += 1
            if sweeps > 60 * (len(q) + 20):
                raise ArithmeticError("dqds did not converge")
            # the next shift: the least eigenvalue of the last 2 x 2, a little less
            a, b, c = q[-2] + (e[-3] if len(e) > 2 else 0.0), q[-1], e[-1]
            half = 0.5 * (a + b + c)
            small = a * b / (half + max(0.0, half * half - a * b) ** 0.5) if half > 0 else 0.0
            shift, failures = 0.98 * min(least, small), 0
        if q:
            found.append(base + q[0])
    return np.sort(np.array(found))[::-1]


def twisted_vector(diagonal, superdiagonal, value: float) -> np.ndarray:
    """Unit eigenvector of B^T B at ``value``: the stationary factorisation
    from the top and the progressive one from the bottom meet at the index
    where the twist leaves the least remainder."""
    q, e, cross = diagonal ** 2, superdiagonal ** 2, diagonal[:-1] * superdiagonal
    n, tiny = len(q), 1e-290 + _EPS ** 4 * value
    top, below = np.zeros(n), np.zeros(n)
    lower, upper = np.zeros(n), np.zeros(n)
    s = -value
    for i in range(n):
        top[i] = s
        if i < n - 1:
            pivot = s + q[i]
            pivot = pivot if abs(pivot) > tiny else tiny
            lower[i] = cross[i] / pivot
            s = e[i] / pivot * s - value
    p = q[-1] - value
    below[-1] = p
    for i in range(n - 2, -1, -1):
        pivot = e[i] + p
        pivot = pivot if abs(pivot) > tiny else tiny
        upper[i] = cross[i] / pivot
        p = p * (q[i] / pivot) - value
        below[i] = p
    k = int(np.argmin(np.abs(top + below + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, all of them; right singular vectors of the
    largest ``most`` that differ from zero).

    Vectors of values closer than a thousandth are made orthogonal to each
    other; where a twisted factorisation has found the same vector again, an
    inverse iteration finds another of that value.
    """
    diagonal, superdiagonal, right = bidiagonalise(r)
    values = dqds(diagonal, superdiagonal)
    floor = (8 * len(values) * _EPS) ** 2 * values[0]
    square = np.diag(diagonal ** 2 + np.append(0.0, superdiagonal ** 2))
    square += np.diag(diagonal[:-1] * superdiagonal, 1) + np.diag(diagonal[:-1] * superdiagonal, -1)
    rng, found = np.random.default_rng(0), []
    for i, value in enumerate(values[:most]):
        if value <= floor:
            break
        z = twisted_vector(diagonal, superdiagonal, value)
        near = [found[j] for j in range(i) if values[j] - value <= 1e-3 * values[j]]
        if near:
            other = np.array(near)
            for attempt in range(8):
                rest = z - other.T @ (other @ z)
                rest -= other.T @ (other @ rest)
                if np.linalg.norm(rest) > 0.5 * np.linalg.norm(z):
                    break
                start = rng.normal(size=len(z)) if attempt % 2 == 0 else rest
                start -= other.T @ (other @ start)
                shaken = value + 16 * _EPS * values[0] * rng.uniform(1, 2, len(z))  # so that it has an inverse
                z = np.linalg.solve(square - np.diag(shaken), start)
                z /= np.linalg.norm(z)
            z = rest / np.linalg.norm(rest)
        found.append(z)
    vectors = right @ np.array(found).T if found else np.zeros((len(values), 0))
    return values, vectors


# ---- the jobs

def integer_vectors(df: DataFrame, vec_col: str) -> DataFrame:
    """``df`` with column x, the integer vector; unusable rows are dropped: a
    null vector, a null or non-finite entry, an entry whose x is no long."""
    usable = F.forall(F.col(vec_col), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(2.0 ** 56)), F.lit(False)))
    x = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))) + F.lit(OFFSET))
    return df.filter(F.col(vec_col).isNotNull()).filter(usable).withColumn("x", x)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, exact sums of each dimension); one row for each dimension comes here."""
    def run(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            low, high = x & 0xFFFFFFFF, x >> 32  # halves cannot overflow
            total = [t + int(lo) + (int(hi) << 32) for t, lo, hi in zip(total, low.sum(axis=0), high.sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()),
                                          "s": pa.array([str(t) for t in total], pa.string())})

    got = (fit.select("x").mapInArrow(run, "dim int, n bigint, s string")
           .groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
           .orderBy("dim").collect())
    return (int(got[0]["n"]), [int(r["s"]) for r in got]) if got else (0, [0] * dim)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they hold it, else Python integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) <= _LONG:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _triangle(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """R of all centred rows, folded in tasks and then 16 tasks at a time."""
    spark = fit.sparkSession

    def fold(rows, r):
        return np.linalg.qr(np.vstack([r, rows]), mode="r")

    def blocks(batches):
        r = np.zeros((0, dim))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column(0).slice(start, BLOCK_ROWS), dim)
                r = fold((_scaled(x, n, sums) / n).astype(float), r)
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              "r": pa.array([r.tobytes()], pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, dim))
        for b in rows.sort_values("part")["r"]:
            r = fold(np.frombuffer(b).reshape(-1, dim), r)
        return pd.DataFrame({"part": [int(rows["part"].min()) // FAN_IN], "r": [r.tobytes()]})

    parts = _saved(fit.select("x").mapInArrow(blocks, "part bigint, r binary"))
    while parts.count() > 1:
        parts = _saved(parts.groupBy(F.expr(f"part div {FAN_IN}").alias("to"))
                       .applyInPandas(merge, "part bigint, r binary"))
    only = parts.first()
    r = np.zeros((dim, dim))
    if only:
        got = np.frombuffer(only["r"]).reshape(-1, dim)
        r[:len(got)] = got
    return r


def _saved(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "whitening")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _identity_error(fit: DataFrame, dim: int, n: int, sums: list[int], project: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    k = project.shape[1]

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_scaled(_matrix(batch.column(0), dim), n, sums) / n).astype(float) @ project
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()),
                                          "s": pa.array(total.ravel(), pa.float64())})

    got = (fit.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
           .orderBy("at").collect())
    total = np.array([r["s"] for r in got]).reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row
    for each usable vector and each component up to ``components``.

    Rows are dropped whose vector is null, empty, holds a null or non-finite
    entry or one so large that x is no long; where vectors differ in length,
    the most frequent length stays (of equally frequent ones the longest).
    Repeated rows count once in the fit list and each get their rows.  A
    component without variance is not returned, so a single distinct vector
    gives no row, nor does an empty table.  Ids may be null or repeated.  A
    deviation beyond a long is null.  Extra columns are ignored.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = integer_vectors(embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector")), "vector")
    id_type = rows.schema["id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"id {id_type}, {_SCHEMA}").withColumnRenamed("id", id_col)
    common = (rows.groupBy(F.size("x").alias("dim")).count().filter("dim > 0")
              .orderBy(F.desc("count"), F.desc("dim")).first())
    if common is None:
        return nothing
    dim = common["dim"]
    rows = rows.filter(F.size("x") == dim)
    fit = _saved(rows.select("x").distinct())
    n, sums = _sums(fit, dim)
    values, vectors = principal(_triangle(fit, dim, n, sums), components)
    k = vectors.shape[1]
    if not k:
        return nothing
    project = vectors / np.sqrt(values[:k] / n)
    explained = values[:k] / values.sum()
    error = _identity_error(fit, dim, n, sums, project)
    shared = spark.sparkContext.broadcast(project)  # dim x components

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                scaled = _scaled(_matrix(part.column("x"), dim), n, sums)
                most = max(abs(int(scaled.max())), abs(int(scaled.min())))
                exact = scaled if most * most * dim <= _LONG else scaled.astype(object)
                deviation = [int(v) if v <= _LONG else None for v in (exact * exact).sum(axis=1)]
                white = (scaled / n).astype(float) @ shared.value
                each = np.repeat(np.arange(part.num_rows), k)
                size = len(each)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id").take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)),
                    "n": pa.array(np.full(size, n, dtype=np.int64)),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(white.ravel(), pa.float64()),
                    "explained": pa.array(np.tile(explained, part.num_rows), pa.float64()),
                    "identity_error": pa.array(np.full(size, error), pa.float64())})

    return (rows.select("id", "x").mapInArrow(run, f"id {id_type}, {_SCHEMA}").withColumnRenamed("id", id_col))
