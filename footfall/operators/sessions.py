"""Session analytics: aggregation, filters, length distributions, a stratified sample, top categories.

Every function takes and returns DataFrames. Actions have the columns of sources.ACTION_COLUMNS;
`action_time` is a timestamp. Rankings have a total order, so reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from footfall import functions as X
from footfall.params import TaskParams

#: The buckets of visit length in seconds and of step length in actions.
VISIT_BUCKETS = {"1s_3s": (1, 3), "4s_6s": (4, 6), "7s_9s": (7, 9), "10s_30s": (10, 30), "30s_60s": (31, 60), "1m_3m": (61, 180), "3m_10m": (181, 600), "10m_30m": (601, 1800), "30m": (1801, None)}
STEP_BUCKETS = {"1_3": (1, 3), "4_6": (4, 6), "7_9": (7, 9), "10_30": (10, 30), "30_60": (31, 60), "60": (61, None)}
DETAIL_COLUMNS = ["user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids"]


def aggregate(actions: DataFrame, users: DataFrame) -> DataFrame:
    """One row a session, with its user's attributes; sessions of unknown users go.

    visit_length is in whole seconds, step_length in actions; keywords and categories are sorted sets.
    """
    sessions = actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.array_sort(F.collect_set("search_keyword")).alias("search_keywords"),
        F.array_sort(F.collect_set(F.col("click_category_id").cast("string"))).alias("click_category_ids"),
        F.min("action_time").alias("start_time"),
        F.max("action_time").alias("end_time"),
        F.count("*").alias("step_length"),
    )
    sessions = sessions.withColumn("visit_length", X.whole_seconds("end_time", "start_time")).drop("end_time")
    return sessions.join(users.select("user_id", "age", "professional", "city", "sex"), "user_id")


def conditions(params: TaskParams) -> list[Column]:
    """What the set filters ask for. A bound without its partner is no filter; a missing attribute fails."""
    found = []
    if params.start_age is not None and params.end_age is not None:
        found.append(F.col("age").between(params.start_age, params.end_age))
    for name, allowed in (("professional", params.professionals), ("city", params.cities)):
        if allowed is not None:
            found.append(F.col(name).isin(allowed))
    if params.sex is not None:
        found.append(F.col("sex") == params.sex)
    for name, allowed in (("search_keywords", params.keywords), ("click_category_ids", params.category_ids)):
        if allowed is not None:
            found.append(F.arrays_overlap(name, F.array(*map(F.lit, allowed))))
    return found


def filtered(sessions: DataFrame, params: TaskParams) -> DataFrame:
    return sessions.filter(reduce(lambda a, b: a & b, conditions(params), F.lit(True)))


def within(value: str, low: int, high: int | None) -> Column:
    return F.col(value) >= low if high is None else F.col(value).between(low, high)


def distribution(sessions: DataFrame) -> DataFrame:
    """One row: how many sessions there are and the share of each length bucket, two digits.

    A visit of 0 seconds is in no bucket and counted on its own; without sessions the shares are null.
    """
    each = {f"visit_{k}": within("visit_length", *b) for k, b in VISIT_BUCKETS.items()} | {f"step_{k}": within("step_length", *b) for k, b in STEP_BUCKETS.items()}
    total = sessions.agg(F.count("*").alias("session_count"), F.count_if(F.col("visit_length") == 0).alias("visit_0s"), *[F.count_if(c).alias(k) for k, c in each.items()])
    return total.select("session_count", "visit_0s", *[X.ratio(k, "session_count").alias(f"{k}_ratio") for k in each])


def sample(sessions: DataFrame, total: int = 100) -> DataFrame:
    """A sample dealt evenly over the days, and within a day in proportion to its hours.

    An hour gives min(floor(its share of the day * the day's quota), its count) sessions, those with the
    smallest hashes; no hour gives more than the day's quota, so every window keeps a bounded top.
    """
    keyed = sessions.withColumns({"date": X.date_text("start_time"), "hour": F.hour("start_time")})
    hours = keyed.groupBy("date", "hour").agg(F.count("*").alias("n"))
    by_day = W.partitionBy("date")
    hours = hours.withColumns({"day_n": F.sum("n").over(by_day), "first": F.when(F.col("hour") == F.min("hour").over(by_day), 1)})
    hours = hours.withColumn("days", F.count("first").over(W.partitionBy(F.lit(0))))  # 24 rows a day at most
    quota = hours.select("date", "hour", F.expr(f"least(n * ({total} div days) div day_n, n)").alias("quota"))
    rank = F.row_number().over(W.partitionBy("date", "hour").orderBy(F.md5("session_id"), "session_id"))
    ranked = keyed.withColumn("rank", rank).filter(F.col("rank") <= total)
    return ranked.join(F.broadcast(quota), ["date", "hour"]).filter("rank <= quota").drop("rank", "quota")


def details(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The actions of the given sessions, each once."""
    return actions.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select(*DETAIL_COLUMNS)


def of_sessions(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """All columns of the actions that belong to the sessions."""
    return actions.join(sessions.select("session_id"), "session_id", "left_semi").select(*actions.columns)


def ids_of(csv: str) -> Column:
    return F.transform(F.split(csv, ","), lambda x: x.try_cast("long"))


def category_counts(actions: DataFrame) -> DataFrame:
    """(category_id, click_count, order_count, pay_count): one pass over the actions."""
    kinds = {"click": F.array(F.col("click_category_id")), "order": ids_of("order_category_ids"), "pay": ids_of("pay_category_ids")}

    def named(kind: str, ids: Column) -> Column:
        pairs = F.transform(ids, lambda x: F.struct(x.alias("category_id"), F.lit(kind).alias("kind")))
        return F.coalesce(pairs, F.array().cast("array<struct<category_id:bigint,kind:string>>"))

    each = actions.select(F.explode(F.concat(*[named(k, ids) for k, ids in kinds.items()])).alias("x")).select("x.*").filter("category_id is not null")
    return each.groupBy("category_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds])


def top_categories(actions: DataFrame, n: int = 10) -> DataFrame:
    order = [F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), F.asc("category_id")]
    return category_counts(actions).orderBy(*order).limit(n)


def top_sessions(actions: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    """(category_id, session_id, click_count, rank): the n sessions with most clicks of each given category.

    categories are a top list, a few rows, so they may be broadcast.
    """
    clicks = actions.filter("click_category_id is not null").groupBy(F.col("click_category_id").alias("category_id"), "session_id").agg(F.count("*").alias("click_count"))
    some = clicks.join(F.broadcast(categories.select("category_id")), "category_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id"))
    return some.withColumn("rank", rank).filter(F.col("rank") <= n)
