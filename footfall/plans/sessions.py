"""Session and page-flow queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.operators import funnel
from footfall.operators import sessions as ops
from footfall.params import TaskParams
from footfall.plans import views

AGES = TaskParams(start_age=20, end_age=60)
ALL_FILTERS = TaskParams.parse('{"startAge": ["20"], "endAge": ["60"], "sex": ["male"], "professionals": ["BUILDING,MACHINERY,FURNITURE"], "cities": ["FRANCE,CHINA,BRAZIL,JAPAN,NATION_1,NATION_2,NATION_3"], "keywords": ["kw1,kw2,kw3"], "categoryIds": ["1,2,3,11"]}')
FLOW = [1, 2, 3, 4]
SAMPLE = 3000


def all_sessions(spark: SparkSession, sf_dir: str, by_month: bool = False) -> DataFrame:
    return ops.aggregate(sources.user_visit_action(spark, sf_dir, by_month), sources.user_info(spark, sf_dir))


def kept_sessions(spark: SparkSession, sf_dir: str, by_month: bool = False) -> DataFrame:
    return ops.filtered(all_sessions(spark, sf_dir, by_month), AGES)


def kept_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.of_sessions(sources.user_visit_action(spark, sf_dir), kept_sessions(spark, sf_dir))


def flat(sessions: DataFrame) -> DataFrame:
    """Lists and times as text, as the result tables have them."""
    return sessions.withColumns({"search_keywords": F.array_join("search_keywords", ","), "click_category_ids": F.array_join("click_category_ids", ","), "start_time": X.time_text("start_time")})


def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(ops.sample(kept_sessions(spark, sf_dir), SAMPLE)).select("session_id", "date", "hour", "start_time", "search_keywords", "click_category_ids")


def detailed(details: DataFrame) -> DataFrame:
    return details.withColumn("action_time", X.time_text("action_time"))


def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed(ops.details(sources.user_visit_action(spark, sf_dir), ops.sample(kept_sessions(spark, sf_dir), SAMPLE)))


def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_categories(kept_actions(spark, sf_dir))


def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = kept_actions(spark, sf_dir)
    return ops.top_sessions(actions, ops.top_categories(actions))


def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detailed(ops.details(sources.user_visit_action(spark, sf_dir), b7(spark, sf_dir)))


def save_report(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The session tables of one task, each as Parquet; what they share is computed once and let go in the end."""
    sessions = kept_sessions(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    actions = ops.of_sessions(sources.user_visit_action(spark, sf_dir), sessions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sampled, top = ops.sample(sessions, SAMPLE), ops.top_categories(actions)
        best = ops.top_sessions(actions, top)
        tables = {"distribution": ops.distribution(sessions), "sample": flat(sampled), "sample_details": ops.details(actions, sampled), "top_categories": top, "top_sessions": best, "top_details": ops.details(actions, best)}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        actions.unpersist()
        sessions.unpersist()


QUERIES = {
    "b1_session_aggregation": lambda s, d: flat(all_sessions(s, d)),
    "b2_session_filter": lambda s, d: flat(ops.filtered(all_sessions(s, d), ALL_FILTERS)),
    "b3_length_distribution": lambda s, d: ops.distribution(kept_sessions(s, d)),
    "b3_length_distribution_by_month": lambda s, d: ops.distribution(kept_sessions(s, d, True)),
    "b4_session_sample": b4,
    "b5_sample_details": b5,
    "b6_top_categories": b6,
    "b7_top_category_sessions": b7,
    "b8_top_session_details": b8,
    "b9_page_conversion": lambda s, d: funnel.conversion(sources.user_visit_action(s, d), FLOW),
    "b9_page_conversion_text": lambda s, d: funnel.conversion_text(funnel.conversion(sources.user_visit_action(s, d, True), FLOW)),
    "s6_actions_by_date": lambda s, d: detailed(sources.between_dates(sources.user_visit_action(s, d), "2024-01-05", "2024-01-07").select(*ops.DETAIL_COLUMNS)),
}

COLUMNS = "session_id, user_id, search_keywords, click_category_ids, start_time, visit_length, step_length, age, professional, city, sex"
DETAILS = "user_id, session_id, page_id, strftime(action_time, '%Y-%m-%d %H:%M:%S') as action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids"
SAMPLED = f"""h as (select strftime(t0, '%Y-%m-%d') as date, hour(t0) as hour, count(*) as n from kept group by all),
q as (select date, hour, least(n * ({SAMPLE} // (select count(distinct date) from h)) // sum(n) over (partition by date), n) as quota from h),
r as (select *, strftime(t0, '%Y-%m-%d') as date, hour(t0) as hour, row_number() over (partition by strftime(t0, '%Y-%m-%d'), hour(t0) order by md5(session_id), session_id) as rk from kept),
sampled as (select r.* from r join q on r.date = q.date and r.hour = q.hour where rk <= quota)"""
TOP = """each as (select click_category_id as c, 'click' as kind from kept_actions union all select cast(unnest(string_split(order_category_ids, ',')) as bigint), 'order' from kept_actions
  union all select cast(unnest(string_split(pay_category_ids, ',')) as bigint), 'pay' from kept_actions),
top as (select c as category_id, count(*) filter (kind = 'click') as click_count, count(*) filter (kind = 'order') as order_count, count(*) filter (kind = 'pay') as pay_count
  from each where c is not null group by c order by 2 desc, 3 desc, 4 desc, 1 limit 10)"""
TOP_SESSIONS = f"""{TOP}, cs as (select click_category_id as category_id, session_id, count(*) as click_count from kept_actions where click_category_id in (select category_id from top) group by all),
ts as (select *, row_number() over (partition by category_id order by click_count desc, session_id) as rank from cs qualify rank <= 10)"""


def share(n: str, total: str) -> str:
    return f"(({n}) * 200 + ({total})) // (2 * ({total})) / 100"


def distribution_sql(by_month: bool) -> str:
    def each(name: str, column: str, low: int, high: int | None) -> str:
        test = f"{column} >= {low}" + ("" if high is None else f" and {column} <= {high}")
        return f"{share(f'count(*) filter ({test})', 'count(*)')} as {name}_ratio"

    cols = [each(f"visit_{k}", "visit_length", *b) for k, b in ops.VISIT_BUCKETS.items()] + [each(f"step_{k}", "step_length", *b) for k, b in ops.STEP_BUCKETS.items()]
    return f"{views.sessions(by_month)} select count(*) as session_count, count(*) filter (visit_length = 0) as visit_0s, {', '.join(cols)} from kept"


def conversion_sql(by_month: bool) -> str:
    return f"""with {views.actions(by_month)},
h as (select page_id, lag(page_id) over (partition by session_id order by action_time, event_id) as before from actions),
c as (select count(*) filter (page_id = 1) as n0, count(*) filter (before = 1 and page_id = 2) as n1, count(*) filter (before = 2 and page_id = 3) as n2, count(*) filter (before = 3 and page_id = 4) as n3 from h),
t as (select 1 as step, '1_2' as hop, n1 as hop_count, {share('n1', 'nullif(n0, 0)')} as rate from c union all select 2, '2_3', n2, {share('n2', 'nullif(n1, 0)')} from c
  union all select 3, '3_4', n3, {share('n3', 'nullif(n2, 0)')} from c)"""


def any_of(column: str, values: list[str]) -> str:
    return f"list_has_any(string_split({column}, ','), [{', '.join(repr(v) for v in values)}])"


def one_of(column: str, values: list[str]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


SQL = {
    "b1_session_aggregation": f"{views.sessions()} select {COLUMNS} from sessions",
    "b2_session_filter": f"{views.sessions()} select {COLUMNS} from kept where sex = 'male' and {one_of('professional', ALL_FILTERS.professionals)} and {one_of('city', ALL_FILTERS.cities)} and {any_of('search_keywords', ALL_FILTERS.keywords)} and {any_of('click_category_ids', ALL_FILTERS.category_ids)}",
    "b3_length_distribution": distribution_sql(False),
    "b3_length_distribution_by_month": distribution_sql(True),
    "b4_session_sample": f"{views.sessions()}, {SAMPLED} select session_id, date, hour, start_time, search_keywords, click_category_ids from sampled",
    "b5_sample_details": f"{views.sessions()}, {SAMPLED} select {DETAILS} from actions where session_id in (select session_id from sampled)",
    "b6_top_categories": f"{views.sessions()}, {TOP} select * from top",
    "b7_top_category_sessions": f"{views.sessions()}, {TOP_SESSIONS} select * from ts",
    "b8_top_session_details": f"{views.sessions()}, {TOP_SESSIONS} select {DETAILS} from actions where session_id in (select session_id from ts)",
    "b9_page_conversion": f"{conversion_sql(False)} select * from t",
    "b9_page_conversion_text": f"{conversion_sql(True)} select string_agg(hop || '=' || coalesce(cast(rate as varchar), ''), '|' order by step) as convert_rate from t",
    "s6_actions_by_date": f"with {views.actions()} select {DETAILS} from actions where date between '2024-01-05' and '2024-01-07'",
}
