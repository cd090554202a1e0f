"""Embedding whitening by a covariance of two passes.

The first pass adds up whole components, exactly, which gives the mean; the second adds up outer
products of what is left after the mean, one matrix product a batch. Each task makes one small partial
sum (width x width numbers), and a tree adds these up, so the driver gets one matrix, however many rows
there are. Its eigenvectors, found there, are broadcast (width x components numbers), and every row is
projected by itself. A third pass measures the whitened values' own covariance.

The operator's driver work is bounded by the width alone; a lost executor's partial sums are made again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, scaled, sliced, whole

OFFSET = 100_000
COMPONENTS = 8
#: Eigenvalues up to this share of the greatest are rounding, not variance.
NOTHING = 1e-12
#: Levels of the trees that add up partial sums.
DEPTH = 3


@dataclass
class Whitener:
    """n rows with the exact sums of their components; unit eigenvectors (columns), eigenvalues falling, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def less_mean(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly; as Python's integers where longs can't hold it."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * most + max(map(abs, self.sums), default=0) < 2**63:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.less_mean(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) @ self.vectors) / np.where(self.has_variance(), np.sqrt(np.abs(self.values)), np.nan)

    def has_variance(self) -> np.ndarray:
        return (self.values > 0) & (self.values > NOTHING * max(self.values, default=0.0))


def partial_sums(rows: DataFrame) -> DataFrame:
    """(n, high, low) of each task's rows x; the sum of component j is high[j] * 2^32 + low[j]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in sliced(batches):
            lists = b.column(0)
            width = max(len(high), int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
            more = width - len(high)
            high, low = np.append(high, np.zeros(more, np.int64)), np.append(low, np.full(more, n * OFFSET))
            x = matrix(lists, width, OFFSET)
            high, low, n = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64()))], ["n", "high", "low"])

    return rows.mapInArrow(run, "n long, high array<long>, low array<long>")


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """How many rows, and each component's sum; shorter vectors count as ending in zeros."""

    def add(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
        width = max(len(a[1]), len(b[1]))
        p, q = ([*s, *[n * OFFSET] * (width - len(s))] for n, s in (a, b))
        return a[0] + b[0], [x + y for x, y in zip(p, q, strict=True)]

    parts = partial_sums(rows).rdd.map(lambda r: (r["n"], [(h << 32) + k for h, k in zip(r["high"], r["low"], strict=True)]))
    return parts.treeAggregate((0, []), add, add, DEPTH)


def outer_products(rows: DataFrame, of, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many rows, the mean of of(x), and the sum of outer products less that mean; `of` makes rows of `width` floats."""

    def merged(a, b):
        if a[0] == 0 or b[0] == 0:
            return b if a[0] == 0 else a
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)

    nothing = (0, np.zeros(width), np.zeros((width, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = nothing
        for b in sliced(batches):
            y = of(b.column(0))
            mean = y.mean(0)
            total = merged(total, (len(y), mean, (y - mean).T @ (y - mean)))
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1].tobytes()]), pa.array([total[2].tobytes()], pa.large_binary() if width > 16_000 else pa.binary())], ["n", "mean", "products"])

    def opened(r):
        return r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(width, width)

    return rows.mapInArrow(run, "n long, mean binary, products binary").rdd.map(opened).treeAggregate(nothing, merged, merged, DEPTH)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener:
    """The mean of all rows x, and the first components of their covariance (divisor n)."""
    n, sums = exact_sums(rows)
    if n == 0 or not sums:
        return Whitener(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    width, mean = len(sums), Whitener(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    _, _, products = outer_products(rows, lambda lists: mean.centred(matrix(lists, width, OFFSET)), width)
    covariance = products / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, first]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Whitener(n, sums, vectors * sign, values[first], float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitener) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity; null if no component has variance."""
    some, width = model.has_variance(), len(model.sums)
    if not some.any():
        return None
    n, _, products = outer_products(rows, lambda lists: model.whitened(matrix(lists, width, OFFSET))[:, some], int(some.sum()))
    return float(np.abs(products / n - np.eye(int(some.sum()))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    A row's x is floor(1024 * c) + 100000 of each of its components c; rows without a whole vector go.
    Vectors shorter than the longest count as ending in zeros. Components are numbered from 1, as many as
    asked for or as the vectors are wide; their sign makes the greatest entry positive. Null and repeated
    ids and repeated rows are rows like any other; other columns are not read. `deviation` is null where
    it exceeds a long; `whitened` is null for components without variance (one row, equal rows), and so
    is `explained` where nothing varies. An empty table, or vectors without components, give no rows.
    """
    rows = whole(df, vector).select(F.col(f"`{id_col}`").alias("id"), scaled(vector, OFFSET).alias("x"))
    only = rows.select("x")
    model = fit(only, components)
    error, width, k = identity_error(only, model), len(model.sums), len(model.values)
    share = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    shared = df.sparkSession.sparkContext.broadcast((model, error, share))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, wrong, shares = shared.value
        for b in sliced(batches) if k else ():
            x = matrix(b.column(1), width, OFFSET)
            apart = fitted.less_mean(x)
            most = int(np.abs(apart).max())
            far = [v if v < 2**63 else None for v in ((apart if most**2 * width < 2**63 else apart.astype(object)) ** 2).sum(1).tolist()]
            each, out = len(x), fitted.whitened(x).T.ravel()
            ids = pa.concat_arrays([b.column(0)] * k)
            numbers = pa.array(np.repeat(np.arange(1, k + 1, dtype=np.int32), each))
            cols = [ids, numbers, pa.array(np.full(each * k, fitted.n)), pa.array(far * k, pa.int64()), pa.array(out, mask=np.isnan(out)), pa.array([s for s in shares for _ in range(each)], pa.float64()), pa.array([wrong] * (each * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(run, f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
