"""Stateful streams over files of events, read to their end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.operators import visits
from footfall.plans import views
from footfall.sources import sinks
from footfall.streaming import behaviour

GAP = "3 hours"
THRESHOLD, LASTS = 2, timedelta(hours=36)
#: Days of a month in a micro-batch, and which files the repeated stream has in which order.
DAYS, AGAIN = 8, (0, 1, 1, 2, 0, 3)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.parquet(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def in_files(df: DataFrame, folder: str, at: str, mark: int, order: tuple[int, ...] = (0, 1, 2, 3), rows: int = sinks.FILE_ROWS) -> DataFrame:
    """The rows as a stream of a micro-batch for every eight days, and two more with rows of user `mark` only, long after all.

    The first of these moves the watermark past all rows; timers fire with the batch of the second. Each micro-batch
    is the same number of files, so that many tasks write and read it.
    """
    spark, part = df.sparkSession, F.least((F.dayofmonth(at) - 1) / DAYS, F.lit(3)).cast("int")
    parts = sinks.by_part(df, part, f"{folder}.rows")
    n = sinks.files_of_parts(parts, rows)
    for i, k in enumerate(order):
        sinks.in_files(parts.filter(F.col("part of") == k).drop("part of"), f"{folder}/{i}", n)
    last = parts.agg(*[F.max(c).alias(c) for c in df.columns])
    for i in (1, 2):
        end = last.withColumns({at: F.col(at) + F.expr(f"interval {30 * i} days"), "user_id": F.lit(mark).cast("long")})
        spark.range(0, n, 1, n).join(F.broadcast(end)).drop("id").write.parquet(f"{folder}/{len(order) + i}")  # a row in each of n files
    return sources.parquet_stream(spark, f"{folder}/*", maxFilesPerTrigger=str(n))


def read_to_end(stream: DataFrame, folder: str, tables: bool = False) -> DataFrame:
    path = f"{folder}/out"
    behaviour.appended(stream, path, tables=tables).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path).filter("user_id >= 0")


def shown(visited: DataFrame) -> DataFrame:
    return visited.withColumns({"start": X.time_text("start"), "end": X.time_text("end")})


def t_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = sinks.shared_folder(spark)
    stream = in_files(events(spark, sf_dir).select("user_id", "ts"), f"{folder}/in", "ts", -1)
    return shown(read_to_end(behaviour.visits(stream, GAP), folder))


def t_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = sinks.shared_folder(spark)
    clicks = sources.ad_clicks(spark, sf_dir).select("user_id", "ad_id", "ts")
    stream = in_files(clicks, f"{folder}/in", "ts", -1)
    found = read_to_end(behaviour.listings(stream, THRESHOLD, LASTS), folder, tables=True)
    return found.withColumns({"at": X.time_text("at"), "until": X.time_text("until")})


def t_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = sinks.shared_folder(spark)
    kind = lambda k, at: events(spark, sf_dir).filter(F.col("event_type") == k).select("user_id", F.col("event_id").alias(f"{k}_id"), F.col("ts").alias(at))
    purchases = in_files(kind("purchase", "bought_at"), f"{folder}/purchases", "bought_at", -1)
    clicks = in_files(kind("click", "clicked_at"), f"{folder}/clicks", "clicked_at", -2)
    found = read_to_end(behaviour.attributed(purchases, clicks), folder)
    return found.withColumns({"bought_at": X.time_text("bought_at"), "clicked_at": X.time_text("clicked_at")})


def t_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, of a stream in which two files come twice."""
    folder = sinks.shared_folder(spark)
    stream = in_files(events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts"), f"{folder}/in", "ts", -1, AGAIN)
    found = read_to_end(behaviour.once(stream, ["event_id"], "10 days"), folder)
    return found.groupBy(X.date_text("ts").alias("date"), "event_type").agg(F.count("*").alias("n"))


QUERIES = {
    "b28_gap_visits": lambda s, d: shown(visits.gap_visits(events(s, d), GAP)),
    "t_gap_visits": t_visits,
    "t_expiring_listings": t_listings,
    "t_attributed_purchases": t_attributed,
    "t_messages_once": t_once,
}

TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"
VISITS = f"""with g as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) > interval {GAP}, true) as new from events),
v as (select *, count(*) filter (new) over (partition by user_id order by ts) as visit from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as end, count(*) as n from v group by user_id, visit"""
SQL = {
    "b28_gap_visits": VISITS,
    "t_gap_visits": VISITS,
    "t_expiring_listings": f"""with recursive {views.CLICKS}, c as (select user_id, ad_id, date_trunc('millisecond', ts) as ts, cast(ts as date) as day from clicks),
l as (select user_id, timestamp '1970-01-01' as free, cast(null as bigint) as ad_id, cast(null as timestamp) as listed_at from c group by user_id
  union all
  select user_id, min(ts) + interval '{int(LASTS.total_seconds())} seconds', arg_min(ad_id, ts), min(ts) from (
    select c.*, row_number() over (partition by c.user_id, c.day, c.ad_id order by c.ts) as k from c join l on c.user_id = l.user_id and c.ts >= l.free) as x
  where k = {THRESHOLD} group by user_id)
select user_id, 'listed' as event, ad_id, strftime(listed_at, '%Y-%m-%d %H:%M:%S') as "at", strftime(free, '%Y-%m-%d %H:%M:%S') as until from l where listed_at is not null
union all select user_id, 'released', null, strftime(free, '%Y-%m-%d %H:%M:%S'), null from l where listed_at is not null""",
    "t_attributed_purchases": f"""with p as (select user_id, event_id as purchase_id, ts as bought_at from events where event_type = 'purchase'),
c as (select user_id as clicker, event_id as click_id, ts as clicked_at from events where event_type = 'click')
select user_id, purchase_id, {TEXT.format("bought_at")}, click_id, {TEXT.format("clicked_at")} from p left join c on user_id = clicker and clicked_at <= bought_at and clicked_at >= bought_at - interval 1 hour""",
    "t_messages_once": "select strftime(ts, '%Y-%m-%d') as date, event_type, count(*) as n from events group by all",
}
