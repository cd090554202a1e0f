"""Mixing sources to target weights by subset sums.

Sources in code point order, null last, get the weights in turn; shares of the budget stop at
`MOST` times a source's size and the excess goes to the others by weight. A source is taken whole as
often as its target allows. For the rest, documents are counted by exact size; each size gives its
proportional part, long sizes fill up what is left to within `REST` words, and a bounded-knapsack
table over the sizes' remaining counts picks the sum nearest to the target.

Which documents of a size are taken is decided by a seeded hash of the whole row (`draw`): it deals
them in slices, slices are taken whole up to one, and in that one draws are taken in order up to one.
Only rows that agree in id, text and all kept columns share a draw. They are exchangeable, so of the
draw at the border as many as needed are taken by a salt. So nothing ranks more than a slice, even
where a size, a null id or one repeated row has a third of all documents, and the kept rows travel
with nothing but the plans' join.

Plans (a row a source and size) and sources are counted and broadcast while they are few. Beyond that
the plans' join shuffles, and sizes with many documents are salted.

What one task holds of a source is its counts by size: with k different sizes the source has at least
k * k / 2 words. Counts are exact whatever their size. A null text has size 0; documents of size 0
are in no mix (taken 0). Null ids are allowed; rows that repeat are documents of their own. Very long
texts are read whole. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, durable

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
REST, SLICE, MOST_SLICES = 16_384, 100, 4096
MOST_BROADCAST, SPREAD = 200_000, 100_000


def sized(docs: DataFrame, keep: list[str], seed: int) -> DataFrame:
    """The columns `keep` with `source of`, size and draw."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.col(f"`{c}`") for c in keep]
    draw = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in sorted({*keep, "text"})])
    return docs.select(*kept, F.col("source").alias("source of"), words.alias("size"), draw.alias("draw"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_no, source_size, target), one row a source; the windows see one row a source.

    With sources in the order of limit/weight, those at the front stop at their limits; the others
    get one multiple of their weights.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    all_ = W.partitionBy(F.lit(0))
    total = total.withColumn("source_no", F.row_number().over(all_.orderBy(F.col("source").asc_nulls_last())))
    total = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1))
    total = total.withColumn("limit", most * F.col("source_size"))
    order = all_.orderBy(F.col("limit") / F.col("weight"), "source_no")
    upto, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    left = share * F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(upto), F.lit(0))
    total = total.withColumn("each", left / F.sum("weight").over(rest))
    free = F.when(F.col("limit") / F.col("weight") > F.col("each"), F.col("each"))
    total = total.withColumn("each", F.first(free, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("limit"), F.coalesce(F.col("each") * F.col("weight"), F.col("limit"))).cast("double")
    return total.select("source", "source_no", "source_size", target.alias("target"))


def nearest(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """How many of each length make the sum nearest to the budget (bounded knapsack; ties go below).

    Counts are split into powers of two; the table keeps for each sum the first part that reaches it.
    """
    top = 2 * budget
    part, reached = np.full(top + 1, -1, np.int32), np.zeros(top + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for length, count in zip(lengths, counts, strict=True):
        n = 1
        while count > 0 and not reached[budget]:
            n = min(n, count)
            if n * length <= top:
                w = n * length
                new = np.flatnonzero(reached[: top + 1 - w] & ~reached[w:]) + w
                part[new], reached[new] = len(parts), True
                parts.append((length, n))
            count -= n
            n *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget), keepdims=False)])
    out: dict[int, int] = {}
    while at:
        length, n = parts[part[at]]
        out[length] = out.get(length, 0) + n
        at -= length * n
    return out


def plan(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """For one source's counts by size: how many documents of each size to take beyond the whole passes."""
        pdf = pdf.sort_values("size", ignore_index=True)
        size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
        whole, target = int(pdf["source_size"][0]), float(pdf["target"][0])
        passes = int(target // whole) if whole else 0
        budget = round(target - passes * whole)
        take = np.minimum(n, np.array([int(x) * budget // max(1, whole) for x in n], np.int64))  # the product may not fit 64 bits
        take[size == 0] = 0
        left = budget - int((take * size).sum())
        for i in range(len(size) - 1, -1, -1):
            if size[i] and left > REST:
                more = min(int(n[i] - take[i]), (left - REST) // int(size[i]))
                take[i] += more
                left -= more * int(size[i])
        place = {int(s): i for i, s in enumerate(size)}
        some = np.random.default_rng(seed).permutation(np.flatnonzero((size > 0) & (n > take) & (size <= 2 * left)))
        for length, more in nearest([int(x) for x in size[some]], [int(x) for x in (n - take)[some]], left).items():
            take[place[length]] += more
        return pdf[["source_no", "size", "n", "source_size", "target"]].assign(passes=passes, take=take)

    return run


def planned(rows: DataFrame, plans: DataFrame, most: int = MOST_BROADCAST, spread: int = SPREAD) -> DataFrame:
    """rows with the plan of their source and size.

    Beyond `most` plans, a size with over a thousandth of all documents (and over `spread`) is dealt
    in so many parts that none has more; there are at most 1000 such sizes.
    """
    if plans.count() <= most:
        return rows.join(F.broadcast(plans), ["source_no", "size"])
    least = max(spread, plans.agg(F.sum("n")).first()[0] // 1000)
    parts = F.when(F.col("n") > least, F.ceil(F.col("n") / least)).otherwise(1).cast("int")
    hot = plans.filter(F.col("n") > least).select("source_no", "size", parts.alias("parts"))
    salt = F.floor(F.rand(5) * F.coalesce("parts", F.lit(1))).cast("int")  # any part has the plan
    salted = rows.join(F.broadcast(hot), ["source_no", "size"], "left").withColumn("salt", salt).drop("parts")
    return salted.join(plans.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))), ["source_no", "size", "salt"]).drop("salt")


def cut(counts: DataFrame, by: str) -> DataFrame:
    """Where `rest` documents of each size end, counted along `by`; counts has (source_no, size, rest, by, m).

    Gives (source_no, size, by, rest: how many of the m there are to take): one row a size.
    """
    upto = F.sum("m").over(W.partitionBy("source_no", "size").orderBy(by))
    left = counts.withColumn("rest", F.col("rest") - upto + F.col("m"))
    return left.filter("rest >= 0 and rest < m").select("source_no", "size", by, "rest", "m")


def mix(docs: DataFrame, seed: int = 17, keep: tuple[str, ...] = (), most: int = MOST_BROADCAST, spread: int = SPREAD) -> DataFrame:
    """(doc_id, keep, size, source_size, target, taken) for every row of docs."""
    keep = ["doc_id", *dict.fromkeys(c for c in keep if c != "doc_id")]
    sizes = durable(sized(docs, keep, seed).select(*[f"`{c}`" for c in keep if c != "text"], "source of", "size", "draw"))
    wide = sized(docs, keep, seed) if "text" in keep else sizes  # texts are read again rather than written
    wanted = durable(targets(sizes.withColumnRenamed("source of", "source") if "source" not in keep else sizes))
    numbers = wanted.select(F.col("source").alias("number of"), "source_no")
    if numbers.count() <= most:
        numbers = F.broadcast(numbers)
    numbered = lambda df: df.join(numbers, F.col("source of").eqNullSafe(F.col("number of"))).drop("source of", "number of")
    rows = numbered(sizes.select("source of", "size", "draw"))
    counts = rows.groupBy("source_no", "size").agg(F.count("*").alias("n")).join(wanted.drop("source"), "source_no")
    plans = durable(counts.groupBy("source_no").applyInPandas(plan(seed), "source_no int, size long, n long, source_size long, target double, passes long, take long"))

    slice_ = F.pmod(F.col("draw"), F.least(F.ceil(F.col("n") / SLICE), F.lit(MOST_SLICES)))
    some = plans.filter("take > 0 and take < n").select("source_no", "size", "n", F.col("take").alias("rest"))
    slices = planned(rows, some, most, spread).groupBy("source_no", "size", slice_.alias("cut"), "rest").agg(F.count("*").alias("m"))
    cuts = durable(cut(slices, "cut").drop("m"))
    edge = planned(rows, some.drop("rest").join(cuts, ["source_no", "size"]), most, spread).filter(slice_ == F.col("cut"))
    draws = edge.groupBy("source_no", "size", "rest", "draw").agg(F.count("*").alias("m"))
    draws = cut(draws, "draw").select("source_no", "size", F.col("draw").alias("border"), F.col("rest").alias("last"), F.col("m") > 1)
    draws = draws.toDF("source_no", "size", "border", "last", "shared")
    plans = durable(plans.join(cuts.drop("rest"), ["source_no", "size"], "left").join(draws, ["source_no", "size"], "left"))

    rows = planned(numbered(wide), plans, most, spread).withColumn("slice", slice_)
    whole = F.col("cut").isNull() & (F.col("take") > 0)
    before = (F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & (F.col("draw") < F.col("border")))
    at_border = F.coalesce((F.col("slice") == F.col("cut")) & (F.col("draw") == F.col("border")) & (F.col("last") > 0), F.lit(False))
    rows = rows.withColumn("more", F.coalesce(whole | before, F.lit(False)).cast("int"))
    cols = [F.col(f"`{c}`") for c in keep]
    cols += ["size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).cast("long").alias("taken")]
    if plans.filter("shared and last > 0").isEmpty():
        return rows.select(*cols)
    equal = durable(rows.filter(at_border & F.col("shared")).withColumn("salt", F.monotonically_increasing_id()))
    salts = equal.withColumn("some", F.pmod("salt", F.lit(MOST_SLICES))).withColumnRenamed("last", "rest")
    found = cut(salts.groupBy("source_no", "size", "rest", "some").agg(F.count("*").alias("m")), "some")
    found = durable(found.select("source_no", "size", F.col("some").alias("cut of"), F.col("rest").alias("rest of")))
    salts = salts.join(F.broadcast(found) if found.count() <= most else found, ["source_no", "size"])
    rank = F.row_number().over(W.partitionBy("source_no", "size").orderBy("salt"))
    clear = salts.filter(F.col("some") != F.col("cut of")).withColumn("more", (F.col("some") < F.col("cut of")).cast("int"))
    last = salts.filter(F.col("some") == F.col("cut of")).withColumn("more", (rank <= F.col("rest of")).cast("int"))
    return rows.filter(~(at_border & F.coalesce("shared", F.lit(False)))).select(*cols).union(clear.select(*cols)).union(last.select(*cols))
