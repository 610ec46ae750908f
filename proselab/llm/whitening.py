"""Embedding whitening by a bidiagonal qd solver.

Vectors become fixed-point rows ``x = floor(scale * c) + offset``.  Their sums
are exact integers; rows are centred before anything is multiplied.  Every
task reduces its centred rows block by block to one triangular factor (QR of
the factor so far above the next block), the factors are merged in groups, and
one d x d factor R reaches the driver.  There R is brought to bidiagonal form
by Householder reflections, dqds finds its squared singular values, and a
twisted factorisation at each gives the direction.  A last pass measures the
covariance of the whitened rows against the identity.

Defined cases: a vector that is null, empty, or holds a null, a NaN, an
infinity or an entry whose x needs over 53 bits takes no part; of several
lengths the one with most vectors is taken (the longer of two equal counts).
Null and repeated ids are rows like any other, further columns are not read.
Directions of no variance (sigma below d * eps of the largest) are no
components, so one row, equal rows and an empty table give no component.
``deviation`` is null beyond 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

SCALE, OFFSET = 64, 1_000_000
#: components returned at most
COMPONENTS = 32
#: bytes of doubles in one block of rows
BLOCK_BYTES = 4 << 20
#: groups in which the tasks' factors are merged, level by level
LEVELS = (1024, 32, 1)
EPS = float(np.finfo(np.float64).eps)
#: an off-diagonal square below this share of its neighbour is zero
NEGLIGIBLE = (100 * EPS) ** 2
#: eigenvalues closer than this share are made orthogonal explicitly
CLUSTER = 1e-3


class Whitening(NamedTuple):
    n: int
    low: np.ndarray  # floor(S / n), by dimension
    rest: np.ndarray  # S - n * low
    directions: np.ndarray  # d x components, unit columns
    values: np.ndarray  # eigenvalues of the covariance, falling
    trace: float
    identity_error: float
    scale: int
    offset: int


# ---- rows ---------------------------------------------------------------


def rows_of(column: pa.Array, d: int | None, scale: int, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, fixed-point rows) of the vectors that take part, in
    blocks; ``d`` None: of every length, one length a block."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy().astype(np.int64)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for length in np.unique(size[size > 0]) if d is None else [d]:
        at = np.flatnonzero(size == length)
        step = max(1, BLOCK_BYTES // (8 * int(length)))
        for a in range(0, len(at), step):
            rows = at[a : a + step]
            c = flat[starts[rows][:, None] + np.arange(length)]
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(scale * c)
                ok = (np.abs(x) < 2.0**53).all(axis=1)
            yield rows[ok], x[ok].astype(np.int64) + offset


def centred(x: np.ndarray, low: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S / n, exact up to the last rounding."""
    return (x - low) - rest / n


def deviations(x: np.ndarray, low: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)**2; null beyond 64 bits."""
    top = float(np.abs(x - low).max(initial=0)) + 1.0
    if top * n < 2.0**31 and top * top * n * n * x.shape[1] < 2.0**62:
        c = n * (x - low) - rest
        return (c * c).sum(axis=1).tolist()
    out = []
    for row in (x - low).tolist():
        total = sum((n * c - r) ** 2 for c, r in zip(row, rest.tolist(), strict=True))
        out.append(total if total < 1 << 63 else None)
    return out


# ---- bidiagonal form, singular values, directions ------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right basis v of r = u b v'."""
    a, d = np.array(r, np.float64), len(r)
    v = np.eye(d)
    for k in range(d):
        u = a[k:, k].copy()
        if size := np.linalg.norm(u):
            u[0] += math.copysign(size, u[0])
            u /= np.linalg.norm(u)
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            w = a[k, k + 1 :].copy()
            if size := np.linalg.norm(w):
                w[0] += math.copysign(size, w[0])
                w /= np.linalg.norm(w)
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], int]:
    """One differential qd step with shift s; the place of the first negative
    pivot, or -1 if the shift was below the least eigenvalue."""
    d, qq, ee = q[0] - s, [], []
    for k in range(len(e)):
        if d < 0:
            return qq, ee, k
        top = d + e[k]
        t = q[k + 1] / top if top > 0 else 1.0
        qq.append(top)
        ee.append(e[k] * t)
        d = d * t - s
    qq.append(d)
    return qq, ee, len(e) if d < 0 else -1


def _shift(q: list[float], e: list[float]) -> float:
    """Smaller eigenvalue of the trailing 2 x 2 block: at least the least one."""
    a = q[-2] + (e[-2] if len(e) > 1 else 0.0)
    b = q[-1] + e[-1]
    off, half = q[-2] * e[-1], (a - b) / 2
    high = (a + b) / 2 + math.sqrt(half * half + off)
    return max(0.0, (a * b - off) / high) if high > 0 else 0.0


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of b'b, falling, from the squares of the diagonal and the
    superdiagonal of b."""
    found: list[float] = []
    todo = [(list(map(float, q)), list(map(float, e)), 0.0, 0.0)]
    while todo:
        q, e, shift, lost = todo.pop()
        while q:
            if len(q) == 1:
                found.append(shift + (q[0] + lost))
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= NEGLIGIBLE * (shift + min(q[k], q[k + 1]))), -1)
            if cut >= 0:
                if cut + 2 <= len(q):
                    todo.append((q[cut + 1 :], e[cut + 1 :], shift, lost))
                q, e = q[: cut + 1], e[:cut]
                continue
            if q[-1] > 1.5 * q[0]:  # the small end belongs at the bottom
                q, e = q[::-1], e[::-1]
            s = _shift(q, e)
            for attempt in range(6):
                qq, ee, bad = _transform(q, e, s)
                if bad < 0:
                    break
                # a miss at the last pivot says by how much the shift was too large
                s = max(0.0, s + qq[-1]) if bad == len(e) and attempt < 3 else s / 4 if attempt < 4 else 0.0
            q, e = qq, ee
            total = shift + s  # compensated sum of the shifts
            lost += (shift - total) + s if shift > s else (s - total) + shift
            shift = total
    return np.array(sorted(found, reverse=True))


def twisted(a: np.ndarray, b: np.ndarray, lam: float, nth: int = 0) -> tuple[np.ndarray, float]:
    """Unit vector of b'b - lam from the factorisation twisted where its pivot
    is least (the ``nth`` least), and the correction of lam that it suggests."""
    n, tiny = len(a), EPS * EPS * float((a * a).max())
    s, p = np.empty(n), np.empty(n)
    lower, upper = np.empty(n - 1), np.empty(n - 1)
    s[0] = -lam
    for i in range(n - 1):
        pivot = s[i] + a[i] * a[i]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        lower[i] = a[i] * b[i] / pivot
        s[i + 1] = s[i] * (b[i] * b[i] / pivot) - lam
    p[-1] = a[-1] * a[-1] - lam
    for i in range(n - 2, -1, -1):
        pivot = b[i] * b[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        upper[i] = a[i] * b[i] / pivot
        p[i] = p[i + 1] * (a[i] * a[i] / pivot) - lam
    gamma = s + p + lam
    r = int(np.argsort(np.abs(gamma), kind="stable")[nth])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -upper[i] * z[i]
    size = np.linalg.norm(z)
    return z / size, float(gamma[r]) / float(size * size)


def _block(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit vectors (columns) of one unreduced b'b."""
    lams, n = dqds(a * a, b * b), len(a)
    if n == 1:
        return lams, np.ones((1, 1))
    out = np.zeros((n, n))
    rng = np.random.default_rng(n)
    lead = 0
    for k in range(n):
        lam = float(lams[k])
        if k and lams[k - 1] - lam > CLUSTER * lams[k - 1]:
            lead = k
        z, step = twisted(a, b, lam)
        for _ in range(3):  # Rayleigh corrections, while they are tiny ones
            if not 2 * EPS * lam < abs(step) < 1e-8 * lam:
                break
            lam += step
            z, step = twisted(a, b, lam)
        near = out[:, lead:k]
        for nth in range(1, 4):
            left = z - near @ (near.T @ z)
            if np.linalg.norm(left) > 0.3:
                break
            z = twisted(a, b, lam, min(nth, n - 1))[0]
        if near.shape[1]:
            if np.linalg.norm(z - near @ (near.T @ z)) <= 0.3:  # copies: inverse iteration from elsewhere
                t = np.diag(a * a + np.r_[0, b * b]) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
                t -= lam * (1 + 4 * EPS) * np.eye(n)
                z = rng.normal(size=n)
                for _ in range(3):
                    z -= near @ (near.T @ z)
                    z = np.linalg.lstsq(t, z / np.linalg.norm(z), rcond=None)[0] if np.linalg.norm(z) else rng.normal(size=n)
            for _ in range(2):
                z = z - near @ (near.T @ z)
                z /= np.linalg.norm(z)
        lams[k], out[:, k] = lam, z
    return lams, out


def eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of r'r, falling, and unit eigenvectors (columns); only
    those above the rounding of r."""
    d = len(r)
    top = float(np.abs(r).max(initial=0.0))
    if not top:
        return np.zeros(0), np.zeros((d, 0))
    a, b, v = bidiagonal(r / top)
    floor = EPS * float(np.abs(a).max())
    a = np.where(np.abs(a) < floor, floor, a)
    cuts = [-1, *(k for k in range(d - 1) if abs(b[k]) <= EPS * min(abs(a[k]), abs(a[k + 1]))), d - 1]
    lams, z = np.empty(d), np.zeros((d, d))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        s = slice(lo + 1, hi + 1)
        lams[s], z[s, s] = _block(a[s], b[lo + 1 : hi])
    order = np.argsort(-lams, kind="stable")
    order = order[lams[order] > (d * EPS) ** 2 * lams[order[0]]]
    return lams[order] * top * top, v @ z[:, order]


# ---- jobs ---------------------------------------------------------------


def _merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value from the tasks' values (key int, value binary), merged in
    groups of bounded size; the driver gets a single row."""

    def run(table: pa.Table) -> pa.Table:
        value = merge(table.column("value").to_pylist())
        return pa.table({"key": table.column("key").slice(0, 1), "value": pa.array([value], pa.binary())})

    for width in LEVELS:
        parts = parts.withColumn("key", F.col("key") % width).groupBy("key").applyInArrow(run, "key int, value binary")
    row = parts.first()
    return None if row is None else bytes(row["value"])


def _per_task(source: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        value = fold(batches)
        if value is not None:
            key = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([key, pa.array([value], pa.binary())], names=["key", "value"])

    return source.mapInArrow(run, "key int, value binary")


def _sums(source: DataFrame, scale: int, offset: int):
    """(n, S by dimension) of the commonest length; S as exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in rows_of(batch.column(0), None, scale, offset):
                n, high, low = sums.get(x.shape[1], (0, 0, 0))
                # halves, so that no sum of 64 bits overflows
                sums[x.shape[1]] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
        for d, (n, high, low) in sums.items():
            if n:
                cols = [np.full(d, d, np.int32), np.arange(d, dtype=np.int32), np.full(d, n, np.int64), high, low]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d", "dim", "n", "high", "low"])

    parts = source.mapInArrow(run, "d int, dim int, n bigint, high bigint, low bigint")
    by_dim = parts.groupBy("d", "dim").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    by_length = by_dim.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "high", "low"))).alias("s"))
    row = by_length.orderBy(F.desc("n"), F.desc("d")).first()
    return (0, []) if row is None else (row["n"], [(r["high"] << 32) + r["low"] for r in row["s"]])


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """Three passes: exact sums, triangular factors, a measurement of the
    whitened covariance.  What reaches the driver is d sums, one d x d factor
    and one matrix of components x components."""
    ship_package(vectors.sparkSession)
    source = vectors.select(F.col(column).alias("v"))
    n, total = _sums(source, scale, offset)
    d = len(total)
    low = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], np.int64)
    if not n:
        return Whitening(0, low, rest, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, scale, offset)

    def triangle(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        r = np.zeros((0, d))
        for batch in batches:
            for _, x in rows_of(batch.column(0), d, scale, offset):
                r = np.linalg.qr(np.vstack([r, centred(x, low, rest, n)]), mode="r")
        return r.tobytes() if len(r) else None

    def join(parts: list[bytes]) -> bytes:
        r = np.zeros((0, d))
        for p in parts:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(p).reshape(-1, d)]), mode="r")
        return r.tobytes()

    r = np.frombuffer(_merged(_per_task(source, triangle), join)).reshape(-1, d) / math.sqrt(n)
    square = np.zeros((d, d))
    square[: len(r)] = r
    values, directions = eigen(square)
    keep = min(components, len(values))
    model = Whitening(n, low, rest, directions[:, :keep], values[:keep], float((square**2).sum()), 0.0, scale, offset)
    if not keep:
        return model

    def moments(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        out = None
        for batch in batches:
            for _, x in rows_of(batch.column(0), d, scale, offset):
                if len(x):
                    w = project(x, model)
                    mean = w.mean(axis=0)
                    out = _add(out, (len(w), mean, (w - mean).T @ (w - mean)))
        return None if out is None else _flat(out)

    def add_all(parts: list[bytes]) -> bytes:
        out = None
        for p in parts:
            f = np.frombuffer(p)
            out = _add(out, (f[0], f[1 : 1 + keep], f[1 + keep :].reshape(keep, keep)))
        return _flat(out)

    found = np.frombuffer(_merged(_per_task(source, moments), add_all))
    cov = found[1 + keep :].reshape(keep, keep) / n
    return model._replace(identity_error=float(np.abs(cov - np.eye(keep)).max()))


def _add(a, b):
    """Counts, means and centred products of two sets of rows together."""
    if a is None:
        return b
    (n, mean, m2), (k, mean_b, m2_b) = a, b
    gap = mean_b - mean
    return n + k, mean + gap * (k / (n + k)), m2 + m2_b + np.outer(gap, gap) * (n * k / (n + k))


def _flat(x) -> bytes:
    return np.r_[float(x[0]), x[1], x[2].ravel()].tobytes()


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.low, model.rest, model.n) @ (model.directions / np.sqrt(model.values))


def transform(vectors: DataFrame, model: Whitening, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep``, ``deviation`` and ``whitened`` (one value a component) of
    each row that takes part."""
    ship_package(vectors.sparkSession)
    src = vectors.select(F.col(column).alias("__v"), *keep)
    schema = vectors.select(*keep).schema.add("deviation", T.LongType()).add("whitened", T.ArrayType(T.DoubleType()))
    d = len(model.low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for at, x in rows_of(batch.column(0), d, model.scale, model.offset) if d else ():
                if not len(at):
                    continue
                w = project(x, model)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                cols = [batch.column(i + 1).take(pa.array(at)).cast(target.field(i).type) for i in range(len(keep))]
                cols += [pa.array(deviations(x, model.low, model.rest, model.n), pa.int64()), lists.cast(target.field(len(keep) + 1).type)]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

    return src.mapInArrow(run, schema)


def components(vectors: DataFrame, model: Whitening, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """One row per vector and component: ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    rows = transform(vectors, model, column, keep)
    share = [float(v / model.trace) for v in model.values] or [0.0]
    out = rows.select(*keep, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return out.select(
        *keep,
        (F.col("__at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, share)), F.col("__at")).alias("explained"),
        F.lit(float(model.identity_error)).alias("identity_error"),
    )
