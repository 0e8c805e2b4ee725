"""Embedding whitening: eigenvectors of a distributed covariance, found in float32 and refined in higher precision.

Vectors become whole numbers first, so that counts, sums and deviations are exact. What the driver holds is the
covariance, of the size of the vectors squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeframe.llm.scratch import release, table

SCALE, SHIFT = 1024, 100_000
#: Entries from this size on (1024 times it has no exact double any more) count as non-finite.
LARGEST = float(1 << 42)
#: Sums are kept in two halves, so that they can't leave 64 bits before 2**36 rows.
HALF = 26
#: Sums held by one task before they are passed on.
MOST_SUMS = 1 << 20
#: Refinement arithmetic: 64 bits of mantissa on x86, and at least a double's elsewhere.
WIDE = np.longdouble
#: Eigenvalues closer than this, against the largest, are always a run to be solved by itself: divided by less, WIDE's
#: rounding would be no small correction.
CLOSE = 2.0**-28
ROUNDS = 12


@dataclass(frozen=True)
class Fit:
    """n vectors with the sums `sums` (one whole number a dimension)."""

    n: int
    sums: tuple[int, ...]

    @property
    def base(self) -> np.ndarray:
        """The whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what the mean is above `base`."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean, unrounded but for the last step."""
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """For each row the sum over dimensions of (n * x - sums) squared, exact."""
        y = x - self.base
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, y.shape[1]) < 1 << 62:
            d = y * self.n - self.rest
            return pa.array((d * d).sum(1)).cast(pa.decimal128(38, 0))
        d = y.astype(object) * self.n - self.rest.astype(object)
        return pa.array([Decimal(int(v)) for v in (d * d).sum(1)], pa.decimal128(38, 0))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the column v: which rows have only finite entries, lengths, first entries, and all entries."""
    col = batch.column(batch.schema.get_field_index("v"))
    at = np.asarray(col.offsets).astype(np.int64)
    entries = col.values.to_numpy(zero_copy_only=False)  # a null entry is NaN here
    bad = np.r_[0, np.cumsum(~(np.abs(entries) < LARGEST))]
    good = np.asarray(col.is_valid()) & (bad[at[1:]] == bad[at[:-1]])
    return good, np.diff(at), at[:-1], entries


def _whole(entries: np.ndarray) -> np.ndarray:
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def _of_width(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are finite and of that width, and their whole numbers."""
    good, lengths, first, entries = _rows(batch)
    rows = np.flatnonzero(good & (lengths == width))
    return rows, _whole(entries[first[rows, None] + np.arange(width)])


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for width, (n, high, low) in held.items():
            yield pa.RecordBatch.from_pydict({"width": np.full(width, width, np.int64), "dim": np.arange(width), "n": np.full(width, n, np.int64), "high": high, "low": low})
        held.clear()

    for batch in batches:
        good, lengths, _, _ = _rows(batch)
        for width in np.unique(lengths[good]):
            _, x = _of_width(batch, width)
            n, high, low = held.get(int(width), (0, 0, 0))
            held[int(width)] = [n + len(x), high + (x >> HALF).sum(0), low + (x & (1 << HALF) - 1).sum(0)]
        if sum(held) > MOST_SUMS:
            yield from rows()
    yield from rows()


def _products(batches: Iterable[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(fit.sums), len(fit.sums)))
    for batch in batches:
        c = fit.centred(_of_width(batch, len(fit.sums))[1])
        total += c.T @ c
    i, j = np.triu_indices(len(total))
    yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})


def _project(batches: Iterable[pa.RecordBatch], fit: Fit, axes: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, x = _of_width(batch, len(fit.sums))
        with np.errstate(divide="ignore", invalid="ignore"):
            w = fit.centred(x) @ axes / np.sqrt(sizes)
        w[:, sizes <= 0] = np.nan
        flat = pa.array(w.ravel(), from_pandas=True)  # NaN is null
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1]), flat)
        kept = batch.column(batch.schema.get_field_index("id")).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([kept, fit.deviations(x), lists], names=["id", "deviation", "whitened"])


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One refinement by matrix products: better eigenvectors, eigenvalues, the distance below which two of these can't
    be told apart yet, and what was wrong before: the largest entry of the residual and of the products less the identity."""
    r = np.eye(len(a), dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    apart = 2 * (np.sqrt((off * off).sum()) + np.sqrt((values * values).sum()) * np.sqrt((r * r).sum()))
    apart = max(apart, np.abs(values).max() * CLOSE)
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > apart
    wrong = s + values[None, :] * r
    e = np.where(far, wrong / np.where(far, gap, 1), r / 2)
    return x + x @ e, values, float(apart), float(max(np.abs(wrong[far]).max(initial=0) / np.abs(values).max(), np.abs(r).max()))


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns, made so to WIDE's digits: one step of Newton's method."""
    return x @ (3 * np.eye(x.shape[1], dtype=WIDE) - x.T @ x) / 2


def _told_apart(a: np.ndarray, x: np.ndarray, values: np.ndarray, apart: float) -> np.ndarray:
    """Eigenvectors of each run of eigenvalues closer than `apart` turned within their own span: the run's small matrix,
    less its mean, is solved by itself, so that its differences aren't lost beside its size."""
    x = _orthonormal(x)
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    for run in np.split(order, cuts):
        if len(run) > 1:
            span = x[:, run]
            small = span.T @ (a @ span)
            small -= np.eye(len(run), dtype=WIDE) * (np.trace(small) / len(run))
            size = np.abs(small).max()
            if size > 0:
                turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(float))[1].astype(WIDE)
                x[:, run] = span @ _orthonormal(turn)
    return x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric matrix a, falling, and unit eigenvectors as columns, to double precision.

    Starts from float32 eigenvectors and corrects them by matrix products in WIDE until what is wrong is below a
    double's last digit or falls no more. The entry of largest size in each eigenvector is positive.
    """
    size = np.abs(a).max(initial=0)
    if not len(a) or size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    scaled = a.astype(WIDE) / WIDE(size)
    x = np.linalg.eigh((a / size).astype(np.float32))[1].astype(WIDE)
    before = np.inf
    for _ in range(ROUNDS):
        x, values, apart, wrong = _step(scaled, x)
        x = _told_apart(scaled, x, values, apart)
        if wrong < 2.0**-56 or (wrong < 2.0**-45 and wrong >= before / 2):
            break
        before = wrong
    values = (x * (scaled @ x)).sum(0)
    order = np.argsort(-values)
    x, values = (x / np.sqrt((x * x).sum(0)))[:, order], values[order]
    largest = np.abs(x).argmax(0)
    x = x * np.where(x[largest, np.arange(len(a))] < 0, -1, 1)
    return (values * size).astype(float), x.astype(float)


def fitted(vectors: DataFrame) -> Fit | None:
    """Count and sums of the vectors (column v) that take part: those of the most frequent width, of these the narrowest."""
    sums = vectors.mapInArrow(_sums, "width long, dim long, n long, high long, low long").groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    sums = table(sums, "sums")
    best = sums.where("dim = 0").orderBy(F.desc("n"), "width").select("width", "n").first()
    rows = sums.where(F.col("width") == best.width).select("dim", "high", "low").collect() if best else []
    release(sums)
    return Fit(best.n, tuple((r.high << HALF) + r.low for r in sorted(rows))) if best else None


def covariance(vectors: DataFrame, fit: Fit) -> np.ndarray:
    """Of the fit's vectors, centred before they are multiplied, divisor n."""
    d = len(fit.sums)
    sums = vectors.mapInArrow(partial(_products, fit=fit), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    v = np.zeros((d, d))
    for r in sums:
        v[r.i, r.j] = v[r.j, r.i] = r.v / fit.n
    return v


def whiten(rows: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id_column, n (long), deviation (decimal), whitened and explained (arrays, one entry a component) and identity_error.

    An entry c counts as x = floor(1024 c) + 100000. Components are unit eigenvectors of x's covariance by falling
    eigenvalue e, at most `components` of them and at most one a dimension. whitened is x less its mean, projected on the
    component, over sqrt(e); explained is e over the covariance's trace; deviation is the exact sum of (n x - sum)^2;
    identity_error is the largest entry, in size, of whitened's measured covariance less the identity.

    Left out: rows whose vector is null or has a null or non-finite entry, or one of 2**42 or more in size; and rows of
    another width than the most frequent one (of equally frequent ones the narrowest), so empty vectors too. Repeated
    rows and ids count each time; an id may be null. A component without variance (e no larger than rounding) has null
    in whitened and explained 0, and takes no part in identity_error, which is null if no component is left. One
    row, or equal rows only: all components are such. No vectors: an empty result. Other columns are not read.

    Three passes over the vectors; each task passes on one row for a dimension or for a pair of dimensions, which are
    summed by a shuffle. The driver gets the covariance: width squared numbers.
    """
    vectors = rows.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    kind = rows.schema[id_column].dataType.simpleString()
    fit = fitted(vectors.select("v"))
    none = F.lit(None).cast("double")
    if fit is None:
        return vectors.where(F.lit(False)).select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array(none).alias("whitened"), F.array(none).alias("explained"), none.alias("identity_error"))
    v = covariance(vectors.select("v"), fit)
    values, axes = eigen(v)
    k = min(components, len(values))
    sizes = np.where(values > len(values) * np.finfo(float).eps * max(values[0], 0), values, 0)[:k]
    explained = sizes / np.trace(v) if np.trace(v) > 0 else sizes
    out = vectors.mapInArrow(partial(_project, fit=fit, axes=axes[:, :k], sizes=sizes), f"id {kind}, deviation decimal(38,0), whitened array<double>")
    out = table(out, "whitened")
    real = np.flatnonzero(sizes > 0).tolist()
    error = None
    if real:
        pairs = [(i, j) for i in real for j in real if i <= j]
        got = out.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return out.select(
        F.col("id").alias(id_column), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*(F.lit(float(e)) for e in explained)).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
