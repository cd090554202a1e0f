"""Advertising queries: each as a batch and as a stream that is read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.operators import ads
from footfall.plans import views
from footfall.sources import sinks
from footfall.streaming import ads as jobs

#: Clicks of one ad by one user on a day that put them on the list; the given tables have few of these.
THRESHOLD = 2
WINDOW = ("60 minutes", "10 minutes")
#: Days of a month in a micro-batch of the streams.
DAYS = 8


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.heavy_users(ads.user_counts(sources.ad_clicks(spark, sf_dir)), THRESHOLD)


def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ads.not_blacklisted(sources.ad_clicks(spark, sf_dir), listed(spark, sf_dir))
    return found.withColumn("ts", X.time_text("ts"))


def streamed(spark: SparkSession, sf_dir: str, rows: int = sinks.FILE_ROWS) -> tuple[DataFrame, str]:
    """The clicks as a stream of four micro-batches, each of the same number of files, and a new folder for a job's tables."""
    folder = sinks.shared_folder(spark)
    part = F.least((F.dayofmonth("ts") - 1) / DAYS, F.lit(3)).cast("int")
    parts = sinks.by_part(sources.ad_clicks(spark, sf_dir), part, f"{folder}/rows")
    n = sinks.files_of_parts(parts, rows)
    for i in range(4):
        sinks.in_files(parts.filter(F.col("part of") == i).drop("part of"), f"{folder}/clicks/{i}", n)
    return sources.parquet_stream(spark, f"{folder}/clicks/*", maxFilesPerTrigger=str(n)), folder


def windows(trend: DataFrame) -> DataFrame:
    return trend.withColumns({"window_start": X.time_text("window_start"), "window_end": X.time_text("window_end")})


def t_user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, folder = streamed(spark, sf_dir)
    return jobs.user_counts(spark, clicks, folder, THRESHOLD).wait().tables["counts"].summed(["date", "user_id", "ad_id"], "click_count")


def t_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, folder = streamed(spark, sf_dir)
    return jobs.user_counts(spark, clicks, folder, THRESHOLD).wait().tables["blacklist"].read().select("user_id")


def t_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, folder = streamed(spark, sf_dir)
    return jobs.running_counts(spark, clicks, folder).wait().tables["counts"].latest(["date", "province", "city", "ad_id"])


def t_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, folder = streamed(spark, sf_dir)
    return jobs.running_counts(spark, clicks, folder).wait().tables["top"].latest(["date", "province"])


def t_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, folder = streamed(spark, sf_dir)
    return windows(jobs.trend(spark, clicks, folder, *WINDOW).wait().tables["trend"].latest(["window_start", "window_end", "ad_id"]))


def t_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, folder = streamed(spark, sf_dir)
    return jobs.minute_counts(spark, clicks, folder).wait().tables["minutes"].latest(["date", "hour", "minute", "ad_id"])


QUERIES = {
    "b11_not_blacklisted": b11,
    "b12_user_counts": lambda s, d: ads.user_counts(sources.ad_clicks(s, d)),
    "b12_blacklist": listed,
    "b13_running_counts": lambda s, d: ads.running_counts(sources.ad_clicks(s, d)),
    "b14_province_top3": lambda s, d: ads.province_top(ads.running_counts(sources.ad_clicks(s, d))),
    "b15_minute_counts": lambda s, d: ads.minute_counts(sources.ad_clicks(s, d)),
    "b15_trend": lambda s, d: windows(ads.trend(sources.ad_clicks(s, d), *WINDOW)),
    "b15_trend_10s": lambda s, d: windows(ads.trend(sources.ad_clicks(s, d))),
    "t_user_counts": t_user_counts,
    "t_blacklist": t_blacklist,
    "t_running_counts": t_running,
    "t_province_top3": t_top,
    "t_trend": t_trend,
    "t_minute_counts": t_minutes,
}

DAY = "strftime(ts, '%Y-%m-%d') as date"
COUNTS = f"counts as (select {DAY}, user_id, ad_id, count(*) as click_count from clicks group by all)"
HEAVY = f"heavy as (select distinct user_id from counts where click_count >= {THRESHOLD})"
PLACES = f"places as (select {DAY}, province, city, ad_id, count(*) as click_count from clicks group by all)"
WITH = f"with {views.CLICKS}"
ALL_COUNTS, BLACKLIST = f"{WITH}, {COUNTS} select * from counts", f"{WITH}, {COUNTS}, {HEAVY} select * from heavy"
RUNNING = f"{WITH}, {PLACES} select * from places"
TOP = f"{WITH}, {PLACES} select date, province, ad_id, cast(sum(click_count) as bigint) as click_count, row_number() over (partition by date, province order by sum(click_count) desc, ad_id) as rank from places group by date, province, ad_id qualify rank <= 3"


def trend_sql(seconds: int) -> str:
    """Windows of an hour that begin every so many seconds."""
    n, step = 3600 // seconds, seconds * 1_000_000
    return f"""{WITH}, w as (select ad_id, unnest(range(0, {n})) as i, epoch_us(ts) // {step} as slot from clicks)
select strftime(make_timestamp((slot - i) * {step}), '%Y-%m-%d %H:%M:%S') as window_start, strftime(make_timestamp((slot - i + {n}) * {step}), '%Y-%m-%d %H:%M:%S') as window_end, ad_id, count(*) as click_count from w group by all"""


MINUTES = f"{WITH} select {DAY}, strftime(ts, '%H') as hour, strftime(ts, '%M') as minute, ad_id, count(*) as click_count from clicks group by all"
#: A user is listed after the batch that makes the count full, and later batches drop the user's clicks.
FED_BACK = f"""{WITH}, {COUNTS}, batched as (select *, least((cast(date[9:10] as integer) - 1) // {DAYS}, 3) as batch from counts),
listed as (select user_id, min(batch) as batch from batched where click_count >= {THRESHOLD} group by user_id)
select date, b.user_id, ad_id, click_count from batched b left join listed l on b.user_id = l.user_id where l.batch is null or b.batch <= l.batch"""
SQL = {
    "b11_not_blacklisted": f"{WITH}, {COUNTS}, {HEAVY} select strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, province, city, user_id, ad_id from clicks where user_id not in (select user_id from heavy)",
    "b12_user_counts": ALL_COUNTS,
    "b12_blacklist": BLACKLIST,
    "b13_running_counts": RUNNING,
    "b14_province_top3": TOP,
    "b15_minute_counts": MINUTES,
    "b15_trend": trend_sql(600),
    "b15_trend_10s": trend_sql(10),
    "t_user_counts": FED_BACK,
    "t_blacklist": BLACKLIST,
    "t_running_counts": RUNNING,
    "t_province_top3": TOP,
    "t_trend": trend_sql(600),
    "t_minute_counts": MINUTES,
}
