"""Ranks over a whole table, without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from footfall.operators import slices

#: Slices by id of one value's rows.
TIES = 64


def ranked(df: DataFrame, value: str, id_col: str, tiles: int = 100, descending: bool = True, pieces: int = slices.PIECES) -> DataFrame:
    """df with position, rank, percent_rank, cume_dist, tile and running: the row's place by (value, id) in all of df.

    `position` numbers the rows that have a value, `rank` the values with gaps (ties share the first place), the
    next two are as in SQL, `tile` is as ntile(tiles), and `running` adds up the value down to the row.
    The value is a whole number and ids are different numbers; rows without a value get nulls.

    Rows are dealt to slices by quantiles of the value; a value with very many rows is a slice by itself and is
    dealt further by id. Each slice is sorted alone, and what the slices before it hold (counts and sums of at most
    (2 * pieces + 1) * (2 * TIES + 1) slices) is added.
    """
    v = F.col(f"`{value}`")
    rows = df.select("*", (-v if descending else v).alias("key of"))
    missing, rows = rows.filter("`key of` is null"), rows.filter("`key of` is not null")
    found, ids = slices.edges(rows, "`key of`", pieces), slices.edges(df, f"`{id_col}`", TIES)
    rows = rows.withColumn("slice of", slices.slice_of("key of", found))
    alone = F.col("slice of") % 2 == 1
    rows = rows.withColumn("part of", F.when(alone, slices.slice_of(id_col, ids)).otherwise(F.lit(0)))

    sizes = rows.groupBy("slice of", "part of").agg(F.count("*").alias("n"), F.sum(v).alias("sum"))
    before = W.orderBy("slice of", "part of").rowsBetween(W.unboundedPreceding, -1)
    in_slice = W.partitionBy("slice of")
    nothing = F.lit(0).cast("long")
    sizes = sizes.select("slice of", "part of", F.coalesce(F.sum("n").over(before), nothing).alias("n before"), F.coalesce(F.sum("sum").over(before), nothing).alias("sum before"), F.sum("n").over(in_slice).alias("n of slice"), F.sum("n").over(W.partitionBy()).alias("n of all"))
    sizes = sizes.withColumn("slice before", F.min("n before").over(in_slice))

    own = W.partitionBy("slice of", "part of").orderBy("key of", id_col)
    ties = W.partitionBy("slice of", "part of").orderBy("key of")
    rows = rows.select("*", F.row_number().over(own).alias("row of"), F.rank().over(ties).alias("rank of"), F.count("*").over(ties).alias("upto of"), F.sum(v).over(own).alias("sum of"))
    rows = rows.join(F.broadcast(sizes), ["slice of", "part of"])
    n, first = F.col("n of all"), F.col("slice before")
    rank = first + F.when(alone, F.lit(1)).otherwise(F.col("rank of"))
    last = first + F.when(alone, F.col("n of slice")).otherwise(F.col("upto of"))
    position = F.col("n before") + F.col("row of")
    made = {"position": position, "rank": rank, "percent_rank": F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)), "cume_dist": last / n, "tile": tile(position, n, tiles), "running": F.col("sum before") + F.col("sum of")}
    out = rows.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(k) for k, c in made.items()])
    return out.unionByName(missing.select(*[F.col(f"`{c}`") for c in df.columns]), allowMissingColumns=True)


def tile(position: Column, n: Column, tiles: int) -> Column:
    """The first n % tiles tiles have one row more than the others."""
    small, more = F.floor(n / tiles), n % tiles
    large = more * (small + 1)
    return F.when(position <= large, F.ceil(position / (small + 1))).otherwise(more + F.ceil((position - large) / F.greatest(small, F.lit(1)))).cast("int")
