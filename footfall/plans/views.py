"""The logical tables as SQL, for the queries' SQL."""

from __future__ import annotations

ACTIONS = """k as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
actions as (select event_id, strftime(ts, '%Y-%m-%d') as date, user_id, {session} as session_id, event_id % 10 as page_id, ts as action_time,
  case when event_type = 'view' then 'kw' || (k % 10) end as search_keyword,
  case when event_type = 'click' then k % 20 end as click_category_id, case when event_type = 'click' then k end as click_product_id,
  case when event_type = 'signup' then (k % 20) || ',' || ((k + 7) % 20) end as order_category_ids, case when event_type = 'signup' then cast(k as varchar) end as order_product_ids,
  case when event_type = 'purchase' then cast(k % 20 as varchar) end as pay_category_ids, case when event_type = 'purchase' then cast(k as varchar) end as pay_product_ids,
  user_id % 25 as city_id from k)"""
BY_DAY, BY_MONTH = "cast(user_id as varchar) || '_' || strftime(ts, '%Y-%m-%d')", "cast(user_id as varchar)"
USERS = """users as (select c_custkey as user_id, 18 + c_custkey % 50 as age, c_mktsegment as professional, n_name as city,
  case when c_custkey % 2 = 0 then 'male' else 'female' end as sex from customer join nation on c_nationkey = n_nationkey)"""
CITIES = "cities as (select n_nationkey as city_id, n_name as city_name, r_name as area from nation join region on n_regionkey = r_regionkey)"
PRODUCTS = "products as (select p_partkey as product_id, p_name as product_name, case when p_partkey % 2 = 0 then 'Self' else 'Third Party' end as product_status from part)"
SESSIONS = """sessions as (select s.*, u.age, u.professional, u.city, u.sex from (
  select session_id, min(user_id) as user_id, coalesce(string_agg(distinct search_keyword, ',' order by search_keyword), '') as search_keywords,
    coalesce(string_agg(distinct cast(click_category_id as varchar), ',' order by cast(click_category_id as varchar)), '') as click_category_ids,
    min(action_time) as t0, strftime(min(action_time), '%Y-%m-%d %H:%M:%S') as start_time,
    (epoch_us(max(action_time)) - epoch_us(min(action_time))) // 1000000 as visit_length, count(*) as step_length
  from actions group by session_id) s join users u on s.user_id = u.user_id)"""
CLICKS = f"""{CITIES}, clicks as (select ts, area as province, city_name as city, user_id, cast(json_extract_string(props, '$.k') as bigint) % 10 as ad_id
  from events join customer on user_id = c_custkey join cities on c_nationkey = city_id where event_type = 'click')"""
LOGINS = """logins as (select event_id, ts, strftime(ts, '%Y-%m-%d') as date, case when event_type = 'signup' then 'exchange_org' else 'login_org' end as event, user_id,
  cast(k % 25 as varchar) as org_id, cast(k % 3 + 1 as varchar) as p_c
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type in ('view', 'click', 'signup')))"""


def actions(by_month: bool = False) -> str:
    return ACTIONS.format(session=BY_MONTH if by_month else BY_DAY)


def sessions(by_month: bool = False) -> str:
    """The CTEs up to `kept`, the sessions that pass the age filter."""
    return f"with {actions(by_month)}, {USERS}, {SESSIONS}, kept as (select * from sessions where age between 20 and 60), kept_actions as (select * from actions where session_id in (select session_id from kept))"
