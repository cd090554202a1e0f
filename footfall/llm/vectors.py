"""Vectors as whole numbers: which rows take part, and Arrow lists as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components count in units of a 1024th.
UNIT = 1024
#: Whole components beyond this count as this, so that sums with an offset stay within a long.
LARGEST = 2**62
#: Rows that are made into one matrix.
ROWS = 1024


def whole(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector isn't null and holds neither null nor anything that isn't finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    column = F.col(f"`{vector}`")
    return df.filter(column.isNotNull() & F.forall(column, fine))


def scaled(vector: str, offset: int = 0) -> Column:
    """floor(1024 * x) + offset of every component x, as longs."""
    bound = F.lit(float(LARGEST))
    return F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.greatest(-bound, F.least(bound, x.cast("double") * UNIT))).cast("long") + F.lit(offset).cast("long"))


def matrix(lists: pa.ListArray | pa.ChunkedArray, width: int, pad: int = 0) -> np.ndarray:
    """Rows of longs; lists shorter than the width end in `pad`."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if (lengths == width).all():
        return flat.astype(np.int64, copy=False).reshape(len(lists), width)
    out = np.full((len(lists), width), pad, np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of longs, exactly: by floats where they hold every sum, by longs or Python's integers where not."""
    most = lambda m: int(max(m.max(initial=0), -int(m.min(initial=0))))
    bound = most(a) * most(b) * max(1, a.shape[1])
    if bound < 2**53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    return a @ b.T if bound < 2**63 else a.astype(object) @ b.T.astype(object)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, without empty ones."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
