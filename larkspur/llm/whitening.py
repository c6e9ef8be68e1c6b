"""Whitening of embeddings by an exact covariance from polarisation: variances of dimensions and of sums of two dimensions."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import stored

#: Fixed-point form of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 16
#: Entries above this size count as not finite, so that sums stay within 128 bits.
MOST = float(1 << 40)
#: An eigenvalue below this part of the largest is zero: its component has no whitened values.
NULL_SPACE = 1e-12
#: Values of a block that numpy works on at once (64 MB of pair sums).
BLOCK_VALUES = 8 << 20


def fixed_point(embedding: Column, scale: int, most: float = MOST) -> Column:
    """Entries as floor(scale * entry), as long; null where the vector is null or empty or has a null, non-finite or too large entry."""
    good = F.forall(embedding, lambda v: F.coalesce(F.abs(v.cast("double")) * scale <= most, F.lit(False)) & ~F.isnan(v.cast("double")))
    return F.when((F.size(embedding) > 0) & good, F.transform(embedding, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def of_one_length(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows whose array has the most frequent length (of equally frequent ones the greatest), and that length (0 without rows)."""
    top = df.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return df.filter(F.size(column) == d), d


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold a null, non-finite or huge entry (MOST) take no part, nor do those of another
    length than most have. The covariance is over the distinct fixed-point vectors x, of which there are n, with sums S
    per dimension. With y = n*x - S, tasks sum y_i^2 for each dimension and (y_i + y_j)^2 for each pair exactly; Spark
    adds the sums up by pair, and (Q_ij - Q_i - Q_j) / 2 is the sum of y_i * y_j. d * (d + 1) / 2 sums reach the driver,
    whatever the number of rows. deviation is the exact sum of y^2 of the row (null above the range of a long).
    whitened is null for components without variance, and explained where nothing varies. identity_error is measured on
    the values themselves, over the components that have variance. Repeated rows and ids stay; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    x = fixed_point(F.col(f"`{embedding}`"), SCALE)
    all_rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(x, lambda v: v + SHIFT).alias("x")).filter("x is not null")
    rows, d = of_one_length(stored(all_rows, "whitening-rows"), "x")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, d)
    variance, axes = _components(_second_moments(fit, n, sums, d), n, d)
    k = min(components, d)
    vary = variance[:k] > NULL_SPACE * max(variance[:1].max(initial=0.0), 0.0)
    error = _identity_error(fit, n, sums, axes[:, :k][:, vary], variance[:k][vary]) if vary.any() else None
    trace = float(variance.sum())
    explained = [float(v) / trace for v in variance[:k]] if trace > 0 else [None] * k
    scales = [float(np.sqrt(v)) if ok else None for v, ok in zip(variance[:k], vary, strict=True)]
    shape = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], shape)
    base = axes[:, :k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                y = _centred(part.column(1), d, n, sums)
                m = part.num_rows
                deviation = _squares(y)
                flat = (y.astype(np.float64) / n) @ base
                out = np.repeat(np.arange(m), k)
                parts = [pa.array(flat[:, c] / scales[c] if scales[c] else [None] * m, pa.float64()) for c in range(k)]
                white = pa.concat_arrays(parts).take(pa.array(np.arange(m * k).reshape(k, m).T.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(out)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(out)), white, pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, shape)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _centred(column: pa.Array, d: int, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits if all fit, else as Python integers."""
    x = _matrix(column, d)
    if len(x) == 0 or n * max(int(x.max()), -int(x.min()), 1) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, null where a long can't hold it."""
    if y.dtype == object or (y.size and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63):
        return [v if v < 1 << 63 else None for v in (sum(int(a) ** 2 for a in row) for row in y)]
    return (y * y).sum(axis=1).tolist()


def _exact(t: np.ndarray) -> list[int]:
    """The exact sum of squares of each column."""
    if t.dtype == object:
        return [int(v) for v in (t * t).sum(axis=0)]
    most = int(np.abs(t).max(initial=0))
    if most * most * max(len(t), 1) < 1 << 62:
        return [int(v) for v in np.einsum("ij,ij->j", t, t)]
    low, high = t & 0xFFFFF, t >> 20  # limbs of 20 bits; the upper one is signed
    if most < 1 << 42 and len(t) < 1 << 18:
        ll, lh, hh = (np.einsum("ij,ij->j", a, b) for a, b in ((low, low), (low, high), (high, high)))
        return [int(a) + (int(b) << 21) + (int(c) << 40) for a, b, c in zip(ll, lh, hh, strict=True)]
    return _exact(t.astype(object))


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            total = [a + int(v) for a, v in zip(total, x.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([decimal.Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], names=["at", "v"])

    found = {r["at"]: int(r["v"]) for r in fit.mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v")).collect()} if d else {}
    return found.get(0, 0), [found.get(k + 1, 0) for k in range(d)]


def _second_moments(fit: DataFrame, n: int, sums: list[int], d: int) -> dict[tuple[int, int], int]:
    """The exact sums of y_i^2 (at i, i) and of (y_i + y_j)^2 (at i < j)."""
    left, right = np.triu_indices(d, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pair, some = [0] * d, [0] * len(left), False
        step = max(1, BLOCK_VALUES // max(1, len(left)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                some = True
                y = _centred(b.column(0).slice(at, step), d, n, sums)
                single = [a + v for a, v in zip(single, _exact(y), strict=True)]
                for to in range(0, len(left), 256):  # few pairs at once stay in the processor's cache
                    pair[to : to + 256] = [a + v for a, v in zip(pair[to : to + 256], _exact(y[:, left[to : to + 256]] + y[:, right[to : to + 256]]), strict=True)]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(d), left), pa.int32()), pa.array(np.append(np.arange(d), right), pa.int32()), pa.array([decimal.Decimal(v) for v in single + pair], pa.decimal128(38, 0))], names=["i", "j", "v"])

    return {(r["i"], r["j"]): int(r["v"]) for r in fit.mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()} if d else {}


def _components(squares: dict[tuple[int, int], int], n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest on, and eigenvectors as columns; the entry of a vector that is largest in size is positive."""
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = squares[i, i] / n**3  # division of integers, rounded once
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (squares[i, j] - squares[i, i] - squares[j, j]) / (2 * n**3)
    if not d:
        return np.zeros(0), v
    values, axes = np.linalg.eigh(v)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    return values, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def _identity_error(fit: DataFrame, n: int, sums: list[int], axes: np.ndarray, variance: np.ndarray) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity."""
    d, k = axes.shape
    scale = np.sqrt(variance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((k, k)), False
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                some = True
                w = (_centred(b.column(0).slice(at, 8192), d, n, sums).astype(np.float64) / n) @ axes / scale
                total += w.T @ w
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    return max(abs(r["v"] / n - (r["at"] % (k + 1) == 0)) for r in fit.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect())
