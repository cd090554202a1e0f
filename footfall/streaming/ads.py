"""The advertising jobs on a stream of clicks.

Each job is a streaming query that writes one or more `Batches` tables. Counts and windows keep
their state in Spark's state store under a watermark; rankings, which Spark has no streaming form of,
and the blacklist, which feeds back into the next batch, are computed for each micro-batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall import functions as X
from footfall.operators import ads
from footfall.sources.sinks import Batches

USER_COUNTS = "date string, user_id long, ad_id long, click_count long"
PLACE_COUNTS = "date string, province string, city string, ad_id long, click_count long"
TOP = "date string, province string, ad_id long, click_count long, rank int"
MINUTES = "date string, hour string, minute string, ad_id long, click_count long"
SLOTS = "slot timestamp, ad_id long, click_count long"


@dataclass
class Job:
    """A streaming query and the tables that it fills."""

    query: StreamingQuery
    tables: dict[str, Batches | Trend]

    def wait(self, seconds: int | None = None) -> Job:
        """Until the query ends; its error, if any, is raised."""
        self.query.awaitTermination(seconds)
        return self


def started(stream: DataFrame, each_batch, folder: str, name: str, mode: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each_batch).outputMode(mode).option("checkpointLocation", f"{folder}/{name}.checkpoint")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def user_counts(spark: SparkSession, clicks: DataFrame, folder: str, threshold: int = ads.THRESHOLD, every: str | None = None) -> Job:
    """Counts by day, user and ad of clicks that aren't blacklisted, and the blacklist.

    A batch is filtered by the list as earlier batches left it, and only then adds to it. Of the
    counts so far only the keys that the batch touches are summed up, and only their days are read.
    """
    keys = ["date", "user_id", "ad_id"]
    tables = {"counts": Batches(spark, f"{folder}/user_counts", USER_COUNTS, keys, "click_count", part="date"), "blacklist": Batches(spark, f"{folder}/blacklist", "user_id long", ["user_id"])}

    def each_batch(df: DataFrame, batch: int) -> None:
        allowed = ads.not_blacklisted(df, tables["blacklist"].read(batch))
        tables["counts"].write(ads.user_counts(allowed), batch)
        new = tables["counts"].of_batch(batch)
        so_far = of_days(tables["counts"].read(batch + 1), new).join(new.select(*keys), keys, "left_semi")
        heavy = ads.heavy_users(so_far.groupBy(*keys).agg(F.sum("click_count").alias("click_count")), threshold)
        tables["blacklist"].write(heavy.join(tables["blacklist"].read(batch).select("user_id"), "user_id", "left_anti"), batch)

    return Job(started(clicks, each_batch, folder, "user_counts", "append", every), tables)


def of_days(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of the days that new has; a batch has few, and merged tables have a folder for each."""
    return rows.filter(F.col("date").isin([r["date"] for r in new.select("date").distinct().collect()]))


def running_counts(spark: SparkSession, clicks: DataFrame, folder: str, late: str = "2 days", n: int = 3, every: str | None = None) -> Job:
    """Clicks so far by day, province, city and ad, and each day and province's top ads.

    Days leave the state when the watermark has passed them; later clicks of these days are dropped.
    """
    keys, group = ["date", "province", "city", "ad_id"], ["date", "province"]
    tables = {"counts": Batches(spark, f"{folder}/place_counts", PLACE_COUNTS, keys, part="date"), "top": Batches(spark, f"{folder}/province_top", TOP, group, part="date")}
    day = F.window("ts", "1 day").alias("day")
    counted = clicks.withWatermark("ts", late).groupBy(day, "province", "city", "ad_id").agg(F.count("*").alias("click_count"))
    counted = counted.select(X.date_text("day.start").alias("date"), "province", "city", "ad_id", "click_count")

    def each_batch(df: DataFrame, batch: int) -> None:
        tables["counts"].write(df, batch)
        new = tables["counts"].of_batch(batch)
        rows = of_days(tables["counts"].read(batch + 1), new).join(new.select(*group).distinct(), group, "left_semi")
        tables["top"].write(ads.province_top(tables["counts"].last(rows, keys), n), batch)

    return Job(started(counted, each_batch, folder, "running_counts", "update", every), tables)


def minute_counts(spark: SparkSession, clicks: DataFrame, folder: str, late: str = "10 minutes", every: str | None = None) -> Job:
    """Clicks by day, hour, minute and ad: each batch replaces the minutes that it changes."""
    keys = ["date", "hour", "minute", "ad_id"]
    tables = {"minutes": Batches(spark, f"{folder}/minutes", MINUTES, keys, part="date")}
    counted = clicks.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "ad_id").agg(F.count("*").alias("click_count"))
    counted = counted.select(*ads.minute_of("w.start"), "ad_id", "click_count")
    return Job(started(counted, lambda df, batch: tables["minutes"].write(df, batch), folder, "minutes", "update", every), tables)


@dataclass
class Trend:
    """Counts by slide, and the windows that they make when they are read."""

    slots: Batches
    length: str
    slide: str

    def latest(self, keys: list[str] | None = None) -> DataFrame:
        """(window_start, window_end, ad_id, click_count), a row for each window and ad."""
        return ads.windows_of(self.slots.latest(["slot", "ad_id"]), self.length, self.slide)


def trend(spark: SparkSession, clicks: DataFrame, folder: str, length: str = "60 minutes", slide: str = "10 seconds", late: str = "10 minutes", every: str | None = None) -> Job:
    """Clicks by ad in sliding windows; all clicks count, blacklisted users' too.

    State and table have one count for each slide and ad; a click at a slide of ten seconds is in 360
    windows of an hour, which are only made when they are read.
    """
    table = Batches(spark, f"{folder}/slots", SLOTS, ["slot", "ad_id"], part="day", part_of="date_format(slot, 'yyyy-MM-dd')")
    counted = ads.slots(clicks.withWatermark("ts", late), slide)
    return Job(started(counted, lambda df, batch: table.write(df, batch), folder, "trend", "update", every), {"trend": Trend(table, length, slide)})
