"""Joins by time, ranks over a whole table, and rolling counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.operators import intervals, ranks, visits
from footfall.plans import views
from footfall.plans.streams import VISITS, events, shown

TOLERANCE, TILES, DAYS, GAP = "12 hours", 100, 7, "3 hours"


def asof_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it, if that isn't older than half a day."""
    seen = lambda kind, **names: events(spark, sf_dir).filter(F.col("event_type") == kind).select("user_id", *[F.col(c).alias(n) for n, c in names.items()])
    purchases = seen("purchase", purchase_id="event_id", bought_at="ts")
    looked = seen("view", view_id="event_id", viewed_at="ts")
    found = intervals.asof(purchases, looked, ["user_id"], "bought_at", "viewed_at", ["view_id", "viewed_at"], ["view_id"], TOLERANCE, strict=True)
    return found.withColumns({"bought_at": X.time_text("bought_at"), "viewed_at": X.time_text("viewed_at")})


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of visits to one city that overlap in time; a visit is named by its user and when it began."""
    found = visits.gap_visits(events(spark, sf_dir), GAP)
    found = found.select((F.col("user_id") % 25).alias("city_id"), F.concat_ws("_", F.lpad(F.col("user_id").cast("string"), 9, "0"), F.unix_micros("start")).alias("visit"), "start", "end")
    pairs = intervals.overlaps(found, "city_id", "start", "end", "visit")
    return pairs.select("city_id", "a", "b", (F.unix_micros("until") - F.unix_micros("from")).alias("micros"))


def customer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by what they spent, in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    spent = sources.parquet(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum(cents).alias("spent"))
    return ranks.ranked(spent, "spent", "custkey", TILES)


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by quantity, of which there are few: each value is held by very many rows."""
    lines = sources.parquet(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_quantity").cast("long").alias("quantity"))
    return ranks.ranked(lines, "quantity", "line", TILES, descending=False)


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    actives = sources.logins(spark, sf_dir).select("p_c", "user_id", F.to_date("ts").alias("date"))
    found = visits.rolling_users(actives, DAYS, ("p_c",))
    return found.select("p_c", F.date_format("date", "yyyy-MM-dd").alias("date"), "users")


QUERIES = {
    "b29_asof_last_view": asof_views,
    "b30_overlapping_visits": overlapping,
    "b31_customer_ranks": customer_ranks,
    "b31_line_ranks": order_ranks,
    "b32_rolling_users": rolling,
}


def ranks_sql(rows: str, id_col: str, value: str, order: str) -> str:
    return f"""select *, row_number() over (order by {order}, {id_col}) as position, rank() over (order by {order}) as rank, percent_rank() over (order by {order}) as percent_rank,
cume_dist() over (order by {order}) as cume_dist, ntile({TILES}) over (order by {order}, {id_col}) as tile, cast(sum({value}) over (order by {order}, {id_col}) as bigint) as running from ({rows})"""


SQL = {
    "b29_asof_last_view": f"""with p as (select user_id, event_id as purchase_id, ts as bought_at from events where event_type = 'purchase'),
v as (select user_id, event_id as view_id, ts as viewed_at from events where event_type = 'view')
select p.user_id, purchase_id, strftime(bought_at, '%Y-%m-%d %H:%M:%S') as bought_at, case when near then view_id end as view_id, case when near then strftime(viewed_at, '%Y-%m-%d %H:%M:%S') end as viewed_at
from (select p.*, v.view_id, v.viewed_at, bought_at - viewed_at <= interval {TOLERANCE} as near from p asof left join v on p.user_id = v.user_id and p.bought_at > v.viewed_at) as p""",
    "b30_overlapping_visits": f"""with v as (select user_id % 25 as city_id, lpad(cast(user_id as varchar), 9, '0') || '_' || epoch_us(f) as visit, f, t from ({VISITS.replace("strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as end", "min(ts) as f, max(ts) as t")}))
select a.city_id, a.visit as a, b.visit as b, epoch_us(least(a.t, b.t)) - epoch_us(greatest(a.f, b.f)) as micros from v a join v b on a.city_id = b.city_id and a.visit < b.visit and a.f <= b.t and b.f <= a.t""",
    "b31_customer_ranks": ranks_sql("select o_custkey as custkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as spent from orders group by o_custkey", "custkey", "spent", "spent desc"),
    "b31_line_ranks": ranks_sql("select l_orderkey * 10 + l_linenumber as line, cast(l_quantity as bigint) as quantity from lineitem", "line", "quantity", "quantity"),
    "b32_rolling_users": f"""with {views.LOGINS}, d as (select distinct p_c, user_id, cast(ts as date) as date from logins),
c as (select p_c, unnest(generate_series(min(date), max(date), interval 1 day)) as day from d group by p_c)
select c.p_c, strftime(day, '%Y-%m-%d') as date, count(distinct user_id) as users from c join d on c.p_c = d.p_c and d.date <= day and d.date > day - interval {DAYS} days group by all""",
}
