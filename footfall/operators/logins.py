"""Logins and organisation switches.

Rows are (ts, event, user_id, org_id, p_c, event_id): `event` is login_org or exchange_org, p_c the
platform, event_id breaks ties between equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall import functions as X
from footfall.operators.logs import fields

LOGIN, SWITCH = "login_org", "exchange_org"


def from_lines(lines: DataFrame) -> DataFrame:
    """Login rows from log lines (`value`); lines without a readable time or event go.

    The time is `t` in milliseconds; login_type falls back to `l_t`.
    """
    m = lines.select(fields("value").alias("m")).filter(F.col("m").isNotNull())
    get = lambda k: F.try_element_at("m", F.lit(k))
    rows = m.select(
        F.timestamp_millis(get("t").try_cast("long")).alias("ts"), get("event_name").alias("event"), get("uid").alias("user_id"), get("org_id").alias("org_id"),
        get("p_c").alias("p_c"), F.coalesce(get("login_type"), get("l_t")).alias("login_type"), get("phone").alias("phone"), get("os").alias("os"),
        get("hw").alias("hw"), get("nw").alias("nw"), get("vc").alias("vc"), get("ip").alias("login_host"),
    )
    return rows.filter("ts is not null and event is not null").withColumn("event_id", F.xxhash64("ts", "user_id", "org_id", "event"))


def day() -> Column:
    return X.date_text("ts").alias("date")


def active_users(logins: DataFrame) -> DataFrame:
    """Users who logged in, by day and platform."""
    return logins.filter(F.col("event") == LOGIN).groupBy(day(), "p_c").agg(F.count_distinct("user_id").alias("users"))


def user_days(logins: DataFrame) -> DataFrame:
    """Each user's day: the last switch's time, organisation and platform.

    Without a switch the organisation is empty, the platform that of the day's first event, the time null.
    """
    at = F.struct("ts", "event_id")
    switch = F.when(F.col("event") == SWITCH, F.struct("ts", "event_id", "org_id", "p_c"))
    found = logins.groupBy(day(), "user_id").agg(F.max(switch).alias("last"), F.min_by("p_c", at).alias("first_p_c"))
    return found.select("date", "user_id", F.coalesce("last.org_id", F.lit("")).alias("org_id"), F.coalesce("last.p_c", "first_p_c").alias("p_c"), F.col("last.ts").alias("exchange_time"))


def switch_counts(logins: DataFrame) -> DataFrame:
    """(date, key, n): by platform the events of users who didn't switch that day, under `a` the users who did.

    First summed up by user and day, so no events are gathered.
    """
    each = logins.groupBy(day(), "user_id", "p_c").agg(F.count("*").alias("n"), F.max(F.col("event") == SWITCH).alias("switched"))
    users = each.groupBy("date", "user_id").agg(F.max("switched").alias("switched"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("p_c", F.lit("")), "n"))).alias("events"))
    counts = F.when(F.col("switched"), F.create_map(F.lit("a"), F.lit(1).cast("long"))).otherwise(F.col("events"))
    return users.select("date", F.explode(counts).alias("key", "n")).groupBy("date", "key").agg(F.sum("n").alias("n"))


def org_users(logins: DataFrame) -> DataFrame:
    """Different users of each organisation and day."""
    return logins.groupBy(day(), "org_id").agg(F.count_distinct("user_id").alias("users"))


def login_log(logins: DataFrame) -> DataFrame:
    return logins.filter(F.col("event") == LOGIN).drop("event")


def switch_log(logins: DataFrame) -> DataFrame:
    return logins.filter(F.col("event") == SWITCH).select("user_id", "org_id", F.col("ts").alias("exchange_time"))


def switches_by_platform(logins: DataFrame) -> DataFrame:
    return logins.filter(F.col("event") == SWITCH).groupBy(day(), "org_id", "p_c").agg(F.count("*").alias("n"))


def latest_logins(logins: DataFrame) -> DataFrame:
    """The latest event of each organisation, user and day."""
    last = F.max(F.struct("ts", "event_id", "p_c")).alias("last")
    found = logins.groupBy(day(), "org_id", "user_id").agg(last)
    return found.select("date", "org_id", "user_id", F.col("last.p_c").alias("p_c"), F.col("last.ts").alias("last_login_time"))
