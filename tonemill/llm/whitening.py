"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become whole numbers, x = floor(64 c) + 1000000, so sums over all
vectors are exact. Three passes over the vectors follow, each a scan without a
shuffle of rows: sums per dimension; the centred scatter, of which each task
makes one matrix; and the covariance of the whitened vectors, which says how
far from the identity it is. The driver gets one matrix of dimension x dimension,
rotates it until the off-diagonal entries vanish beside their diagonal ones,
which keeps small eigenvalues accurate, sorts, and sends the whitening matrix
to the tasks.

Means and scatters of two sets of vectors are merged from the difference of
their means, so every product is of centred numbers.

Defined cases: vectors that are null or hold null, NaN or infinite entries are
dropped, as are those of another length than most have (of equally frequent
lengths the greatest counts) and empty ones; 64 c beyond 2^52 is held at 2^52; a
deviation that no long holds is null; equal eigenvalues get any basis of their
space, and each component the sign that makes its largest entry positive; a
component without variance (a constant or repeated dimension, fewer vectors than
dimensions) has null for ``whitened`` and no part in ``identity_error``, which is
0 if there is no other; with variance nowhere ``explained`` is 0; there are as
many components as dimensions, and no more than asked for; repeated rows and
null ids stay; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT, MOST = 64, 1_000_000, 2.0**52
COMPONENTS = 32
#: Entries that a task works on at once, and tasks that merge what all others found.
_BLOCK, _MERGERS = 1 << 19, 16
_EPS = float(np.finfo(float).eps)


@dataclass
class Moments:
    """Number, mean and centred scatter of vectors."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        centred = rows - mean
        return cls(len(rows), mean, centred.T @ centred)

    def __add__(self, other: Moments | None) -> Moments:
        if other is None:
            return self
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))

    def packed(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": [self.n], "mean": [self.mean.tobytes()], "scatter": [self.scatter.tobytes()]}, _PACKED)

    @classmethod
    def unpacked(cls, n: int, mean: bytes, scatter: bytes) -> Moments:
        m = np.frombuffer(mean)
        return cls(n, m, np.frombuffer(scatter).reshape(len(m), len(m)))


_PACKED = pa.schema([("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary())])


@dataclass
class Centring:
    """n and sums of whole numbers by dimension; `exact` says that n x - S and
    the sums of its squares are known to fit in 64 bits."""

    n: int
    sums: list[int]
    exact: bool

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in whole numbers."""
        if self.exact:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)


def whole(batch: pa.RecordBatch, column: str, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, x) of blocks of a batch whose vectors all have dim finite entries."""
    at = max(1, _BLOCK // dim)
    for i in range(0, batch.num_rows, at):
        part = batch.column(column).slice(i, at)
        c = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), dim)
        yield i, np.clip(np.floor(SCALE * c), -MOST, MOST).astype(np.int64) + SHIFT


def vectors(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The rows to fit, and their dimension (0 if there are none)."""
    finite = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    good = df.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(finite)
    size = F.size(column)
    most = good.groupBy(size.alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = most["dim"] if most else 0
    return good.filter(size == dim), dim


def centring(rows: DataFrame, column: str, dim: int) -> Centring:
    """One row for each task and dimension is summed; dim rows reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, lo, hi = 0, None, None, None
        for batch in batches:
            for _, x in whole(batch, column, dim):
                n += len(x)
                part, low, high = [int(v) for v in x.astype(object).sum(0)] if np.abs(x).max() > 1 << 40 else x.sum(0).tolist(), x.min(0), x.max(0)
                sums, lo, hi = ([a + b for a, b in zip(sums, part, strict=True)], np.minimum(lo, low), np.maximum(hi, high)) if sums else (part, low, high)
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(dim)), "n": [n] * dim, "s": [str(v) for v in sums], "lo": lo, "hi": hi}, pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.string()), ("lo", pa.int64()), ("hi", pa.int64())]))

    parts = rows.select(column).mapInArrow(partial, "i int, n long, s string, lo long, hi long")
    got = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect(), key=lambda r: r["i"])
    n, sums = got[0]["n"], [int(r["s"]) for r in got]
    far = [max(abs(n * r["lo"] - s), abs(n * r["hi"] - s)) for r, s in zip(got, sums, strict=True)]
    return Centring(n, sums, sum(f * f for f in far) < 1 << 62 and all(n * max(abs(r["lo"]), abs(r["hi"])) < 1 << 62 for r in got))


def moments(rows: DataFrame, column: str, dim: int, centre: Centring, to: np.ndarray | None = None) -> Moments:
    """Of x - S / n, or of its product with the matrix ``to``. A task makes one
    matrix, a few tasks add those up as they come, the driver adds theirs."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        for batch in batches:
            for _, x in whole(batch, column, dim):
                z = centre.deviations(x).astype(float) / centre.n
                total = Moments.of(z if to is None else z @ to) + total
        if total:
            yield total.packed()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        for batch in batches:
            for r in batch.to_pylist():
                total = Moments.unpacked(**r) + total
        if total:
            yield total.packed()

    schema = "n long, mean binary, scatter binary"
    parts = rows.select(column).mapInArrow(partial, schema).repartition(_MERGERS).mapInArrow(merged, schema).collect()
    total: Moments | None = None
    for r in parts:
        total = Moments.unpacked(**r.asDict()) + total
    return total


def jacobi(matrix: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, by
    falling eigenvalue. Each sweep rotates every pair of dimensions once; it ends
    when no off-diagonal entry is above rounding beside its two diagonal ones."""
    a, vectors, least = np.array(matrix, float), np.eye(len(matrix)), _EPS**2 * abs(np.trace(matrix))
    for _ in range(sweeps):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if abs(a[p, q]) <= max(_EPS * np.sqrt(abs(a[p, p] * a[q, q])), least):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s, move = t * c, t * a[p, q]
                on_diagonal = a[p, p] - move, a[q, q] + move
                rows = a[[p, q]]
                a[p], a[q] = c * rows[0] - s * rows[1], s * rows[0] + c * rows[1]
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = *on_diagonal, 0.0, 0.0
                both = vectors[:, [p, q]]
                vectors[:, p], vectors[:, q] = c * both[:, 0] - s * both[:, 1], s * both[:, 0] + c * both[:, 1]
        if not turned:
            order = np.argsort(-np.diag(a), kind="stable")
            vectors = vectors[:, order]
            vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(a))] < 0, -1.0, 1.0)
            return np.diag(a)[order], vectors
    raise ArithmeticError(f"off-diagonal entries remain after {sweeps} sweeps")


def whiten(df: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each
    row that is fitted and component."""
    df = df.select(key, column)
    schema = T.StructType([df.schema[key]]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    rows, dim = vectors(df, column)
    if not dim:
        return df.sparkSession.createDataFrame([], schema)
    centre = centring(rows, column, dim)
    first = moments(rows, column, dim, centre)
    variance = first.scatter / first.n
    values, basis = jacobi(variance)
    k, trace = min(components, dim), float(np.trace(variance))
    values, basis = values[:k], basis[:, :k]
    live = values > 8 * dim * _EPS * (np.diag(variance) @ basis**2)
    to = basis * np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    explained = np.maximum(values, 0) / trace if trace else np.zeros(k)
    error = 0.0
    if live.any():
        after = moments(rows, column, dim, centre, to[:, live])
        error = float(np.abs(after.scatter / after.n - np.eye(int(live.sum()))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in whole(batch, column, dim):
                d = centre.deviations(x)
                far = [int(v) for v in (d * d).sum(1)]
                white = (d.astype(float) / centre.n) @ to
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column(key).slice(i, m).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n)),
                    pa.array([v if v < 1 << 63 else None for v in far], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(white.ravel(), mask=np.tile(~live, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ], names=schema.names)

    return rows.mapInArrow(project, schema)
