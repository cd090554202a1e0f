"""Slices of an order: how one key's rows, or a whole table's, are split over tasks by value.

Edges are approximate quantiles, so slices have about as many rows each however values cluster. A value
that is an edge has a slice of its own: slice 2i holds what lies strictly between two edges, slice 2i + 1
the edge itself. Edges are few (a parameter) and reach the driver; slices number at most 2 * pieces + 1.
"""

from __future__ import annotations

from itertools import accumulate
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Slices that a table is split into, about.
PIECES = 512
#: Equal cells that edges are looked up by, for each edge.
CELLS = 4


def edges(df: DataFrame, column: str, pieces: int = PIECES) -> list:
    """Different quantiles of a numeric column, in order; none for a column without values."""
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * pieces)).alias("e")).first()["e"]
    return sorted(set(found or []))


def slice_of(column: Column | str, found: list) -> Column:
    """The slice of a value; nulls are in slice 0.

    A value's cell, one of many of equal width, tells how many edges lie in cells before it and which
    ones in its own, so only those are compared. Cells of edges are found here by the same arithmetic.
    """
    c = F.col(column) if isinstance(column, str) else column
    if not found:
        return F.lit(0)
    low, n = float(found[0]), CELLS * len(found)
    step = (float(found[-1]) - low) / n or 1.0
    in_cell: list[list] = [[] for _ in range(n)]
    for e in found:
        in_cell[min(n - 1, floor((float(e) - low) / step))].append(e)
    before = [0, *accumulate(map(len, in_cell))]
    kind, mark = ("double", "D") if isinstance(found[0], float) else ("bigint", "L")
    cell = F.least(F.greatest(F.floor((c.cast("double") - low) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    lists = ", ".join(f"array({', '.join(f'{e!r}{mark}' for e in some)})" if some else f"cast(array() as array<{kind}>)" for some in in_cell)
    own = F.get(F.expr(f"array({lists})"), cell)  # literals as one text; a call for each would take longer than the job
    less = F.get(F.expr(f"array({', '.join(map(str, before))})"), cell) + F.aggregate(own, F.lit(0), lambda s, e: s + (e < c).cast("int"))
    return F.coalesce(2 * less + F.exists(own, lambda e: e == c).cast("int"), F.lit(0))


def carried(marked: DataFrame, by: list[str], value: str, order: str = "slice") -> DataFrame:
    """(by, slice, carried): the last value that isn't null of a key's earlier slices; marked has one row for each key and slice."""
    earlier = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return marked.select(*by, order, F.last(value, ignorenulls=True).over(earlier).alias("carried"))
