"""Visits by gaps of time, and how many users were active in the days up to each day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GAP = "30 minutes"
#: How long a visit's state waits for late events.
LATE = "1 hour"


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c)


def gap_visits(events: DataFrame, gap: str = GAP, by: str = "user_id", at: str = "ts") -> DataFrame:
    """(by, start, end, n): a visit goes on as long as each event is at most `gap` after the one before.

    Events of one key within the same slot of that length are one visit anyway, so they are first
    summed up by slot, before the shuffle; what is then sorted by key is one row a slot, however busy the
    key is. Rows without a key or a time are in no visit.
    """
    length = microseconds(gap)
    slots = events.filter(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(by, F.floor(micros(at) / length).alias("slot"))
    slots = slots.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    in_order = W.partitionBy(by).orderBy("slot")
    apart = micros("first") - micros(F.lag("last").over(in_order)) > length
    numbered = slots.withColumn("visit", F.sum(F.coalesce(apart, F.lit(True)).cast("long")).over(in_order))
    found = numbered.groupBy(by, "visit").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.sum("n").alias("n"))
    return found.drop("visit")


def microseconds(text: str) -> int:
    """A length such as '30 minutes' in microseconds."""
    number, unit = text.split()
    return int(float(number) * 1_000_000 * {"microsecond": 1e-6, "second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")])


def rolling_users(actives: DataFrame, days: int = 7, by: tuple[str, ...] = (), user: str = "user_id", day: str = "date") -> DataFrame:
    """(by, day, users): the different users of the `days` days up to each day from the first to the last of its group.

    A user counts from an active day until `days` days after the last one; so each run of active days
    adds one user when it begins and takes one away when it ends, and the counts are running sums of these
    changes: a row a day, not a row for each of the days that an activity counts for.
    """
    seen = actives.filter(F.col(user).isNotNull() & F.col(day).isNotNull()).select(*by, F.col(user), F.col(day).cast("date").alias(day)).distinct()
    own = W.partitionBy(*by, user).orderBy(day)
    gone = F.datediff(F.lead(day).over(own), day) >= days
    begins = F.coalesce(F.datediff(day, F.lag(day).over(own)) >= days, F.lit(True))
    steps = F.array(F.struct(F.col(day).alias("day"), begins.cast("long").alias("change")), F.struct(F.date_add(day, days).alias("day"), (-F.coalesce(gone, F.lit(True)).cast("long")).alias("change")))
    steps = seen.select(*by, steps.alias("steps")).select(*by, F.explode(F.filter("steps", lambda s: s["change"] != 0)).alias("s"))
    changes = steps.groupBy(*by, F.col("s.day").alias("day")).agg(F.sum("s.change").alias("change"))
    spans = seen.groupBy(*by).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    calendar = spans.select(*by, F.explode(F.sequence("first", "last")).alias("day"))
    every = calendar.join(changes, [*by, "day"], "left")  # changes after a group's last day are of no use
    upto = W.partitionBy(*by or [F.lit(0)]).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return every.select(*by, F.col("day").alias(day), F.sum(F.coalesce("change", F.lit(0).cast("long"))).over(upto).alias("users"))
