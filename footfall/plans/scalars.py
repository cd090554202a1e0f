"""The scalar helpers on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.operators import logs


def x_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(F.lit("id="), F.col("p_partkey"), F.lit("|brand="), F.col("p_brand"), F.lit("|empty=|name="), F.col("p_name"))
    part = sources.parquet(spark, sf_dir, "part").withColumn("record", record).withColumn("csv", F.concat(F.lit(","), F.col("p_brand"), F.lit(",,")))
    return part.select(
        "p_partkey", X.field_of("record", "brand").alias("brand"), X.field_of("record", "empty").alias("nothing"), X.with_field("record", "brand", "x").alias("replaced"),
        X.trim_comma("csv").alias("trimmed"), X.two_digits(F.col("p_partkey") % 100).alias("digits"), X.is_empty(F.nullif("p_brand", F.lit("Brand#11"))).alias("is_empty"),
        X.contains("p_name", "a").alias("has_a"), X.labelled("p_partkey", "p_name").alias("label"), X.without_prefix(X.with_prefix("p_name", 10, "p_partkey")).alias("stripped"),
        X.json_field(F.lit('{"k": [1, 2], "s": "t"}'), "s").alias("field"), X.json_first(F.lit('{"k": [1, 2], "s": "t"}'), "k").alias("first"), X.ratio(F.col("p_partkey") % 7, F.col("p_partkey") % 3).alias("ratio"),
    )


def x_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.parquet(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("text", X.time_text("ts"))
    noon = F.concat(X.date_text("ts"), F.lit(" 9:00:00"))
    return events.select(
        "event_id", X.date_hour("ts").alias("date_hour"), X.date_text("ts").alias("date"), X.date_key("ts").alias("date_key"), X.minute_key("ts").alias("minute_key"),
        X.before("text", noon).alias("before_nine"), X.after("text", noon).alias("after_nine"), X.seconds_between("text", noon).alias("from_nine"), X.seconds_between(F.lit("no time"), noon).alias("unknown"),
        X.is_date(X.date_text("ts")).alias("is_date"), X.is_date(X.date_key("ts")).alias("key_is_date"), X.epoch_text(F.unix_seconds("ts")).alias("epoch_text"), X.epoch_text(F.lit("null")).alias("no_epoch"),
        X.to_millis(X.date_text("ts")).alias("millis"), X.from_millis(F.unix_millis("ts")).alias("day_of_millis"), X.server_millis(F.concat(F.unix_seconds("ts").cast("string"), F.lit(".25"))).alias("server_millis"),
        X.server_millis(F.lit("x")).alias("bad_millis"), *[X.date_part("ts", p).alias(p) for p in ("year", "season", "month", "week", "day", "hour")],
        X.date_text(X.first_day_of_week("ts")).alias("sunday"), X.date_text(X.parse_date_key(X.date_key("ts"))).alias("parsed_key"),
    )


def x_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ua = F.format_string("Mozilla/5.0 (Windows NT %d.0) AppleWebKit/537 (KHTML, like Gecko) Chrome/%d.0 Safari/537", F.col("event_id") % 5 + 6, F.col("event_id") % 40 + 60)
    ua = F.when(F.col("event_id") % 3 == 0, F.format_string("Mozilla/5.0 (X11; Linux x86_64; rv:%d.0) Gecko/20100101 Firefox/%d.0", F.col("event_id") % 40, F.col("event_id") % 40)).otherwise(ua)
    events = sources.parquet(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, ua).alias("ua"))
    return events.select("event_id", logs.user_agent("ua").alias("a")).select("event_id", "a.*")


QUERIES = {"x_text": x_text, "x_time": x_time, "x21_user_agents": x_agents}
SQL = {
    "x_text": """with p as (select *, 'id=' || p_partkey || '|brand=x|empty=|name=' || p_name as replaced from part)
select p_partkey, p_brand as brand, null::varchar as nothing, replaced, p_brand || ',' as trimmed, lpad(cast(p_partkey % 100 as varchar), 2, '0') as digits, p_brand = 'Brand#11' as is_empty,
contains(p_name, 'a') as has_a, p_partkey || ':' || p_name as label, p_name as stripped, 't' as field, '1' as first,
case when p_partkey % 3 > 0 then ((p_partkey % 7) * 200 + p_partkey % 3) // (2 * (p_partkey % 3)) / 100 end as ratio from p""",
    "x_time": """with e as (select *, date_trunc('second', ts) as s, date_trunc('day', ts) as d from events)
select event_id, strftime(ts, '%Y-%m-%d_%H') as date_hour, strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%Y%m%d') as date_key, strftime(ts, '%Y%m%d%H%M') as minute_key,
s < d + interval 9 hour as before_nine, s > d + interval 9 hour as after_nine, (epoch_us(s) - epoch_us(d)) // 1000000 - 32400 as from_nine, 0 as unknown, true as is_date, false as key_is_date,
strftime(ts, '%Y-%m-%d %H:%M:%S') as epoch_text, '' as no_epoch, epoch_us(d) // 1000 as millis, strftime(ts, '%Y-%m-%d') as day_of_millis, epoch_us(s) // 1000 + 250 as server_millis, -1 as bad_millis,
year(ts) as year, quarter(ts) as season, month(ts) as month, (dayofyear(ts) + dayofweek(date_trunc('year', ts)) - 1) // 7 + 1 as week, day(ts) as day, hour(ts) as hour,
strftime(d - to_days(cast(dayofweek(ts) as integer)), '%Y-%m-%d') as sunday, strftime(ts, '%Y-%m-%d') as parsed_key from e""",
    "x21_user_agents": """select event_id, case when event_id % 7 = 0 then null when event_id % 3 = 0 then 'Firefox' else 'Chrome' end as browser,
case when event_id % 7 = 0 then null when event_id % 3 = 0 then (event_id % 40) || '.0' else (event_id % 40 + 60) || '.0' end as browser_v,
case when event_id % 7 = 0 then null when event_id % 3 = 0 then 'Linux' else 'Windows' end as os,
case when event_id % 7 = 0 then null when event_id % 3 = 0 then 'Linux' else 'Windows NT ' || (event_id % 5 + 6) || '.0' end as os_v from events""",
}
