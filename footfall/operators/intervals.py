"""Joins by time: the last row before (as-of), and intervals that overlap."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from footfall.operators import slices
from footfall.operators.visits import micros, microseconds


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str], ties: list[str], tolerance: str | None = None, strict: bool = False, pieces: int = slices.PIECES) -> DataFrame:
    """left with the columns `take` of the latest right row with the same `by`, at or before its time.

    `strict` leaves out right rows of the same time; `tolerance` is how old a right row may be. Of right
    rows with one time the greatest by `ties` counts. Rows of left without a key, a time or such a row get nulls.

    Each key's rows are split into slices of time, by quantiles of all times, so no task holds a busy
    key: a slice is sorted by itself and carries its last right row along; what a slice
    ends with is handed over to the later ones, one row for each key and slice.
    """
    times = left.select(micros(left_at).alias("at")).unionByName(right.select(micros(right_at).alias("at")))
    found = slices.edges(times, "at", pieces)
    keys = [f"key {i}" for i in range(len(by))]
    key, whole = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], reduce(and_, [F.col(k).isNotNull() for k in [*keys, "at"]])
    lefts = left.select(*key, micros(left_at).alias("at"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l"))
    order, taken = F.struct(micros(right_at), *[F.col(f"`{c}`") for c in ties]), F.struct(micros(right_at).alias("at"), *[F.col(f"`{c}`").alias(f"take {i}") for i, c in enumerate(take)])
    # a right row comes before a left one of the same time, or after it if `strict`
    rights = right.select(*key, micros(right_at).alias("at"), F.lit(2 if strict else 0).alias("side"), order.alias("order"), taken.alias("r")).filter(whole)
    rows = lefts.filter(whole).unionByName(rights, allowMissingColumns=True).withColumn("slice", slices.slice_of("at", found))
    in_slice = W.partitionBy(*keys, "slice").orderBy("at", "side", "order").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("own", F.last("r", ignorenulls=True).over(in_slice)).filter("side = 1").select(*keys, "slice", "at", "l", "own")
    ends = slices.carried(rows.groupBy(*keys, "slice").agg(F.max_by("r", "order").alias("last")), keys, "last")
    out = local.join(ends, [*keys, "slice"]).select("at", "l", F.coalesce("own", "carried").alias("r"))
    if tolerance is not None:
        out = out.withColumn("r", F.when(F.col("at") - F.col("r.at") <= microseconds(tolerance), F.col("r")))
    out = out.select("l", "r").unionByName(lefts.filter(~whole).select("l"), allowMissingColumns=True)
    return out.select("l.*", *[F.col("r").getField(f"take {i}").alias(c) for i, c in enumerate(take)])


#: Lengths of a level differ by up to this many doublings. More: fewer rows to shuffle, and more to compare.
DOUBLINGS = 3
#: Rows of a task that joins intervals. The ids of so many fit into the 1 MB that Parquet's dictionary of a column may have.
TASK_ROWS = 20_000


def level(width: Column, base: int, doublings: int = 1) -> Column:
    """0 for lengths up to `base`, and one more each time that 2^`doublings` times as much is allowed."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(width, F.lit(1)) / base) / doublings)).cast("int")


def shortest(counts: dict[int, int]) -> tuple[int, dict[int, int]]:
    """(m, rows): lengths up to 2^m are best at level 0, and so many intervals look into the bins of each level then.

    counts[k] is how many intervals are up to 2^k long, and longer than half of that. Of the m that at most double the
    comparisons (of the intervals at a level with all that look into its bins, over the width of these) it is the one with the fewest rows.
    """
    found = {}
    for m in range(min(counts, default=0), max(counts, default=0) + 1):
        own: dict[int, int] = {}
        for k, n in sorted(counts.items()):
            at = max(0, -(-(k - m) // DOUBLINGS))
            own[at] = own.get(at, 0) + n
        seen = {at: sum(n for lower, n in own.items() if lower <= at) for at in own}
        found[m] = sum(own[at] * seen[at] * 2 ** (m + DOUBLINGS * at) for at in own), seen
    least = min(c for c, _ in found.values())
    m = min((m for m in found if found[m][0] <= 2 * least), key=lambda m: (sum(found[m][1].values()), found[m][0]))
    return m, found[m][1]


def overlaps(df: DataFrame, by: str, start: str, end: str, id_col: str, base: str | None = None) -> DataFrame:
    """(by, a, b, from, until): every pair of intervals [start, end] of one key that share a moment, once, a the smaller id.

    Ids are different. Intervals without a key or an end, or that end before they begin, are in no pair.
    An interval of up to 8^k bases is at level k, whose bins are as wide, so it touches at most two of
    them; it also looks into the bins of the longer levels that occur. A pair meets in the bins of the longer one's level,
    and is taken in that bin only in which the later of the two begins. So long intervals are not cut into many
    pieces, and a busy key is split by time. `base` is chosen by how many intervals have which length unless given.

    A pair comes from the longer of the two. Its pairs follow each other by ids, those with moments before the others, and
    a task has few intervals: there can be very many more pairs than intervals, and so they are written in few bytes.
    """
    b, e = micros(start), micros(end)
    rows = df.select(F.col(f"`{by}`").alias("key"), F.col(f"`{id_col}`").alias("id"), b.alias("b"), e.alias("e")).filter("key is not null and id is not null and b <= e")
    length, unit = F.col("e") - F.col("b"), microseconds(base) if base else 1
    doublings = level(length, unit, DOUBLINGS if base else 1)
    counts = dict(rows.groupBy(doublings).count().collect())  # 64 at most
    least, looking = (0, {k: sum(n for lower, n in counts.items() if lower <= k) for k in counts}) if base else shortest(counts)
    width, tasks = unit << least, 2 + sum(looking.values()) // TASK_ROWS  # what is dealt to one task may be dealt again by the join
    # made from what was counted, as rounded logarithms of other numbers may name a level that wasn't
    rows = rows.withColumn("level", doublings if base else F.greatest(F.lit(0), F.ceil((doublings - least) / DOUBLINGS)).cast("int"))
    longer = F.filter(F.array(*map(F.lit, sorted(looking))) if looking else F.array().cast("array<int>"), lambda k: k >= F.col("level"))
    seen = rows.withColumn("of", F.explode(longer)).withColumn("wide", F.lit(width) * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("of") * DOUBLINGS))
    first = F.floor(F.col("b") / F.col("wide"))
    seen = seen.withColumn("bin", F.explode(F.sequence(first, F.floor(F.col("e") / F.col("wide"))))).withColumn("begins", first == F.col("bin"))
    one = seen.filter("level = of").select("key", "of", "bin", *[F.col(c).alias(f"x_{c}") for c in ("id", "b", "e", "begins")])
    two = seen.select("key", "of", "bin", *[F.col(c).alias(f"y_{c}") for c in ("id", "b", "e", "begins")])
    bins = ["key", "of", "bin"]
    # numbers, as the optimizer takes plain sorts out of what is joined; the merge join keeps the order of windows
    nth = lambda *order: F.row_number().over(W.partitionBy(*bins).orderBy(*order))
    one = one.repartition(tasks, *bins).withColumn("x_nth", nth("x_b", "x_id"))
    two = two.repartition(tasks, *bins).withColumn("y_nth", nth(F.col("y_e") > F.col("y_b"), "y_id"))
    meets = (F.col("x_b") <= F.col("y_e")) & (F.col("y_b") <= F.col("x_e")) & F.when(F.col("x_b") >= F.col("y_b"), F.col("x_begins")).otherwise(F.col("y_begins"))
    x_length, y_length = F.col("x_e") - F.col("x_b"), F.col("y_e") - F.col("y_b")
    once = (x_length > y_length) | ((x_length == y_length) & (F.col("x_id") < F.col("y_id")))
    pairs = one.join(two.hint("merge"), bins).filter(meets & once & (F.col("x_nth") > 0) & (F.col("y_nth") > 0))  # both are dealt and sorted for it
    at = lambda c: F.timestamp_micros(c)
    return pairs.select(F.col("key").alias(by), F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), at(F.greatest("x_b", "y_b")).alias("from"), at(F.least("x_e", "y_e")).alias("until"))
