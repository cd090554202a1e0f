"""Advertising clicks: the same functions serve batches and the micro-batches of a stream.

Clicks are (ts, province, city, user_id, ad_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from footfall import functions as X

THRESHOLD = 100


def parsed(messages: DataFrame) -> DataFrame:
    """Clicks from messages (`value`): `milliseconds province city user ad`; others go."""
    part = lambda i: F.get(F.split("value", " "), F.lit(i))
    read = messages.filter(F.size(F.split("value", " ")) == 5).select(
        F.timestamp_millis(part(0).try_cast("long")).alias("ts"), part(1).alias("province"), part(2).alias("city"), part(3).try_cast("long").alias("user_id"), part(4).try_cast("long").alias("ad_id")
    )
    return read.filter("ts is not null and user_id is not null and ad_id is not null")


def not_blacklisted(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of users who aren't on the list; those without a user stay."""
    return clicks.join(blacklist.select("user_id").distinct(), "user_id", "left_anti").select(*clicks.columns)


def user_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(X.date_text("ts").alias("date"), "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def heavy_users(counts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Users with as many clicks of one ad on one day."""
    return counts.filter(F.col("click_count") >= threshold).select("user_id").distinct()


def running_counts(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(X.date_text("ts").alias("date"), "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_top(counts: DataFrame, n: int = 3) -> DataFrame:
    """The n ads with most clicks of each day and province; counts are by city."""
    summed = counts.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))
    rank = F.row_number().over(W.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id"))
    return summed.withColumn("rank", rank).filter(F.col("rank") <= n)


def minute_counts(clicks: DataFrame) -> DataFrame:
    """(date, hour, minute, ad_id, click_count): what the trend table holds."""
    return clicks.groupBy(*minute_of("ts"), "ad_id").agg(F.count("*").alias("click_count"))


def minute_of(time: str) -> list[Column]:
    """The day, hour and minute of a time, as text."""
    ts = F.col(time)
    return [X.date_text(ts).alias("date"), X.two_digits(F.hour(ts)).alias("hour"), X.two_digits(F.minute(ts)).alias("minute")]


def slots(clicks: DataFrame, slide: str = "10 seconds") -> DataFrame:
    """(slot, ad_id, click_count): clicks by the slide that they are in, from which windows are made."""
    return clicks.groupBy(F.window("ts", slide).alias("w"), "ad_id").agg(F.count("*").alias("click_count")).select(F.col("w.start").alias("slot"), "ad_id", "click_count")


def windows_of(counts: DataFrame, length: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """(window_start, window_end, ad_id, click_count) over the sliding windows that each slot is in."""
    every, whole = (F.expr(f"interval {x}") for x in (slide, length))
    starts = F.filter(F.sequence(F.col("slot") - whole, F.col("slot"), every), lambda t: t + whole > F.col("slot"))
    found = counts.select(F.explode(starts).alias("window_start"), "ad_id", "click_count").groupBy("window_start", "ad_id").agg(F.sum("click_count").alias("click_count"))
    return found.select("window_start", (F.col("window_start") + whole).alias("window_end"), "ad_id", "click_count")


def trend(clicks: DataFrame, length: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """Clicks by ad over sliding windows of event time, counted by slide first; only these counts go to their windows."""
    return windows_of(slots(clicks, slide), length, slide)
