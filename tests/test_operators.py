"""Small inputs with literal results: boundaries, ties, empty tables."""

from __future__ import annotations

import json
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation, Row
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.functions.registered import register
from footfall.operators import ads, basics, funnel, logins, logs, products
from footfall.operators import sessions as ops
from footfall.params import TaskParams, task
from footfall.plans import logs as log_plans

START = datetime(2024, 1, 1, 8)
ACTION = "event_id long, date string, user_id long, session_id string, page_id long, action_time timestamp, search_keyword string, click_category_id long, click_product_id long, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string, city_id long"


def action(n, session="s", page=1, after=0, user=1, **more):
    row = dict.fromkeys(["search_keyword", "click_category_id", "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids"])
    row |= {"event_id": n, "date": "2024-01-01", "user_id": user, "session_id": session, "page_id": page, "action_time": START + timedelta(seconds=after), "city_id": 0} | more
    return tuple(row[c.split()[0]] for c in ACTION.split(", "))


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, 30, "a", "x", "male"), (2, 40, "b", "y", "female"), (3, None, None, None, None)], "user_id long, age int, professional string, city string, sex string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def test_params_take_scalars_and_arrays():
    raw = {"startAge": ["20"], "endAge": 50, "sex": "male", "keywords": ["k1, k2"], "cities": [], "targetPageFlow": "1,2,3"}
    p = TaskParams.parse(json.dumps(raw))
    assert (p.start_age, p.end_age, p.sex, p.keywords, p.cities, p.page_flow) == (20, 50, "male", ["k1", "k2"], None, [1, 2, 3])


def test_task_lookup(spark):
    tasks = spark.createDataFrame([(1, '{"sex": ["male"]}')], "task_id long, task_param string")
    assert task(tasks, 1).sex == "male"
    with pytest.raises(LookupError):
        task(tasks, 2)


def test_sessions_keep_sets_not_substrings(spark, users):
    acts = [action(1, click_category_id=11, search_keyword="ab"), action(2, after=3, click_category_id=1, search_keyword="a"), action(3, session="t", user=9)]
    found = ops.aggregate(spark.createDataFrame(acts, ACTION), users).collect()
    assert [(r.session_id, r.search_keywords, r.click_category_ids, r.visit_length, r.step_length) for r in found] == [("s", ["a", "ab"], ["1", "11"], 3, 2)]


@pytest.mark.parametrize(
    ("params", "kept"),
    [
        (TaskParams(), {1, 2, 3}),
        (TaskParams(start_age=35), {1, 2, 3}),
        (TaskParams(start_age=35, end_age=50), {2}),
        (TaskParams(sex="male"), {1}),
        (TaskParams(cities=["y", "z"]), {2}),
        (TaskParams(professionals=["none"]), set()),
        (TaskParams(keywords=["k1", "k9"]), {1}),
        (TaskParams(category_ids=["1"]), {2}),
    ],
)
def test_filters(spark, users, params, kept):
    acts = [action(1, "a", user=1, search_keyword="k1", click_category_id=11), action(2, "b", user=2, click_category_id=1), action(3, "c", user=3)]
    found = ops.filtered(ops.aggregate(spark.createDataFrame(acts, ACTION), users), params)
    assert {r.user_id for r in found.collect()} == kept


def test_length_buckets(spark):
    visits = [0, 1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 180, 181, 600, 601, 1800, 1801]
    steps = [1, 3, 4, 6, 7, 9, 10, 30, 31, 60, 61, 1, 1, 1, 1, 1, 1, 1]
    r = ops.distribution(spark.createDataFrame(list(zip(visits, steps, strict=True)), "visit_length long, step_length long")).first()
    assert (r.session_count, r.visit_0s, r.visit_30m_ratio) == (18, 1, 0.06)
    assert all(r[f"visit_{k}_ratio"] == 0.11 for k in ops.VISIT_BUCKETS if k != "30m")
    assert (r.step_1_3_ratio, r.step_30_60_ratio, r.step_60_ratio) == (0.5, 0.11, 0.06)


def test_distribution_without_sessions(spark):
    r = ops.distribution(spark.createDataFrame([], "visit_length long, step_length long")).first()
    assert r.session_count == 0 and r.step_60_ratio is None


def test_sample_quotas(spark):
    base = [(f"s{i}", START + timedelta(hours=i % 3)) for i in range(60)] + [("t", START + timedelta(days=1))]
    df = spark.createDataFrame(base, "session_id string, start_time timestamp")
    found = ops.sample(df, 20).groupBy("date", "hour").count()
    assert rows(found) == [("2024-01-01", 8, 3), ("2024-01-01", 9, 3), ("2024-01-01", 10, 3), ("2024-01-02", 8, 1)]
    assert rows(ops.sample(df, 20)) == rows(ops.sample(df.repartition(3), 20))
    assert ops.sample(df.limit(0), 20).count() == 0 and ops.sample(df, 1).count() == 0


def test_categories_of_all_kinds_and_ties(spark):
    acts = [action(1, click_category_id=5), action(2, order_category_ids="5,6"), action(3, pay_category_ids="7"), action(4, click_category_id=4), action(5, order_category_ids="x,")]
    top = ops.top_categories(spark.createDataFrame(acts, ACTION), 3).collect()
    assert [tuple(r) for r in top] == [(5, 1, 1, 0), (4, 1, 0, 0), (6, 0, 1, 0)]


def test_top_sessions_and_details(spark):
    acts = spark.createDataFrame([action(i, f"s{i % 3}", click_category_id=1 + i % 2) for i in range(12)], ACTION)
    top = ops.top_sessions(acts, ops.top_categories(acts, 1), 2)
    assert rows(top) == [(1, "s0", 2, 1), (1, "s1", 2, 2)]
    assert ops.details(acts, top.union(top)).count() == 8  # each action once


def test_funnel(spark):
    pages = [("s", [1, 2, 1, 2, 3]), ("t", [1, 1, 3]), ("u", [2])]
    acts = spark.createDataFrame([action(i, s, p, after=0) for s, all_ in pages for i, p in enumerate(all_)], ACTION)
    assert rows(funnel.conversion(acts, [1, 2, 3])) == [(1, "1_2", 2, 0.5), (2, "2_3", 1, 0.5)]
    assert rows(funnel.conversion(acts, [9, 1, 9])) == [(1, "9_1", 0, None), (2, "1_9", 0, None)]
    assert funnel.conversion_text(funnel.conversion(acts, [1, 2, 3])).first()[0] == "1_2=0.5|2_3=0.5"
    assert funnel.conversion(acts, [1]).count() == 0


def test_products(spark):
    clicks = spark.createDataFrame([(0, 1), (1, 1), (0, 2), (0, 3), (0, 4), (0, None), (9, 1)], "city_id long, product_id long")
    cities = spark.createDataFrame([(0, "x", "China North"), (1, "y", "China North")], "city_id long, city_name string, area string")
    items = spark.createDataFrame([(i, f"p{i}", json.dumps({"product_status": i % 2})) for i in range(5)], "product_id long, product_name string, extend_info string")
    top = products.top_products(products.area_counts(clicks, cities), items)
    assert rows(top, "product_id", "click_count", "city_infos", "area_level", "product_status", "rank") == [(1, 2, "0:x,1:y", "A Level", "Third Party", 1), (2, 1, "0:x", "A Level", "Self", 2), (3, 1, "0:x", "A Level", "Third Party", 3)]


def test_log_fields(spark):
    lines = ["1.2.3.4^A1459581125.573^Ahost^A/log.gif?a=1&&b=&c=%zz&a=2&ip=9&d=x%20y&e=k=v&f", "1.2.3.4^A1^A/log.gif?a=1", "1^A2^A3^A/log.gif", "1.2.3.4^Ax^A^A/p?a=1", "", None]
    found = spark.createDataFrame([(x,) for x in lines], "value string").select(logs.fields("value").alias("m")).collect()
    assert found[0].m == {"ip": "1.2.3.4", "s_time": "1459581125573", "a": "2", "d": "x y", "e": "k=v"}
    assert found[3].m == {"ip": "1.2.3.4", "s_time": "-1", "a": "1"}
    assert [r.m for r in found[1:3] + found[4:]] == [None] * 4


def test_dropped_lines_are_counted(spark):
    seen = Observation("lines")
    df = spark.createDataFrame([("1^A2^A3^A/x?a=1",), ("broken",), (None,)], "value string")
    assert logs.parsed(df, seen).count() == 1
    assert seen.get == {"lines": 3, "dropped": 2}


def test_lines_are_made_once_and_by_many_tasks(spark, sf_dir):
    """What makes the lines isn't repeated in a filter below, and one file of events is no one task."""
    lines = log_plans.visits(spark, sf_dir)
    assert logs.parsed(lines)._jdf.queryExecution().optimizedPlan().toString().count("Chrome/") == 1
    assert lines.rdd.getNumPartitions() == log_plans.TASKS_OF_CORE * spark.sparkContext.defaultParallelism > 1
    odd = spark.createDataFrame([("1^A2^A3^A/x?a=1",), ("1^A2^A3^Ax?",), ("broken",), ("^A^A^A",), ("1^A2^A3^A4?^A5",), (None,)], "value string")
    assert [r.m.get("a") for r in logs.parsed(odd).collect()] == ["1", None]


def test_agents(spark):
    agents = {
        "Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36 Edg/120.1": ("Edge", "120.1", "Windows", "Windows NT 10.0"),
        "Mozilla/5.0 (iPhone; CPU iPhone OS 16_1 like Mac OS X) AppleWebKit/605 Version/16.1 Mobile Safari/604": ("Safari", "16.1", "iOS", "iPhone OS 16_1"),
        "Mozilla/5.0 (Linux; Android 13) Chrome/99.0 Mobile": ("Chrome", "99.0", "Android", "Android 13"),
        "curl": (None, None, None, None),
    }
    found = spark.createDataFrame([(x,) for x in agents], "ua string").select("ua", logs.user_agent("ua").alias("a")).collect()
    assert {r.ua: tuple(r.a) for r in found} == agents
    assert spark.createDataFrame([(" ",)], "ua string").select(logs.user_agent("ua").alias("a")).first().a is None


def test_regions(spark):
    regions = {
        "局域网": ("中国", "上海市", "unknown"), "广东省": ("中国", "广东省", "unknown"), "广东省广州市天河区": ("中国", "广东省", "广州市"), "内蒙古包头市": ("中国", "内蒙古自治区", "包头市"),
        "广西南宁市": ("中国", "广西", "南宁市"), "北京市海淀区": ("中国", "北京市", "海淀区"), "上海市崇明县": ("中国", "上海市", "崇明县"), "香港": ("中国", "香港特别行政区", "unknown"),
        "美国": ("unknown", "unknown", "unknown"), None: ("unknown", "unknown", "unknown"),
    }
    found = spark.createDataFrame([(x,) for x in regions], "r string").select("r", logs.region_parts("r").alias("p")).collect()
    assert {r.r: tuple(r.p) for r in found} == regions


def test_ip_numbers_and_ranges(spark):
    ips = ["0.0.0.0", "1.0.255.255", "1.1.0.0", "1.1.0.1", "256.1.1.1", "1.2.3", None]
    ranges = spark.createDataFrame([(0, 2**24, "a"), (2**24 + 65535, 2**24 + 65536, "b")], "start_ip long, end_ip long, region string")
    found = logs.located(spark.createDataFrame([(x,) for x in ips], "ip string"), ranges).collect()
    assert {r.ip: r.region for r in found} == {"0.0.0.0": "a", "1.0.255.255": "b", "1.1.0.0": "b", "1.1.0.1": None, "256.1.1.1": None, "1.2.3": None, None: None}
    assert spark.range(1).select(logs.ip_text(F.lit(3_232_235_777))).first()[0] == "192.168.1.1"


def test_many_ranges_are_salted(spark, monkeypatch):
    ranges = spark.range(300).select((F.col("id") * 70_000).alias("start_ip"), (F.col("id") * 70_000 + 60_000).alias("end_ip"), F.concat(F.lit("r"), F.col("id")).alias("region"))
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, logs.ip_text(F.col("id") % 7 * 1_000_003)).alias("ip"))
    few = sorted(map(str, logs.located(df, ranges).collect()))
    monkeypatch.setattr(logs, "MOST_BROADCAST", 0)
    many = logs.located(df, ranges)
    assert sorted(map(str, many.collect())) == few and many.count() == 2000


def test_a_report_shares_its_sessions(spark, sf_dir, tmp_path):
    from footfall.plans import sessions

    sessions.save_report(spark, sf_dir, str(tmp_path))
    read = lambda name: sorted(map(str, spark.read.parquet(f"{tmp_path}/{name}").collect()))
    assert read("top_categories") == sorted(map(str, sessions.b6(spark, sf_dir).collect()))
    assert len(read("top_sessions")) == sessions.b7(spark, sf_dir).count() and read("sample_details")


def test_conform(spark):
    from footfall.operators import basics
    from footfall.sources import DEPARTMENT

    got = basics.conform(spark.createDataFrame([("x", 1, 2.0)], "name string, id int, more double"), DEPARTMENT)
    assert got.schema.names == ["id", "name"] and got.first() == (1, "x")


def test_row_keys(spark):
    df = spark.range(1).select(F.create_map(*[F.lit(x) for x in ("s_time", "5", "u_ud", "u", "en", "e_pv")]).alias("m"))
    want = lambda e: f"5_{zlib.crc32(f'u{e}'.encode()) % 10**8}"
    assert tuple(df.select(logs.row_key("m"), logs.row_key("m", "e_e")).first()) == (want("e_pv"), want("e_e"))


LOGIN = "ts timestamp, event string, user_id string, org_id string, p_c string, event_id long"


@pytest.fixture(scope="module")
def some_logins(spark):
    at = lambda h: START + timedelta(hours=h)
    made = [
        (at(1), "login_org", "u", "a", "1", 1), (at(3), "exchange_org", "u", "c", "2", 3), (at(2), "exchange_org", "u", "b", "1", 2),
        (at(1), "login_org", "v", "a", "1", 4), (at(2), "login_org", "v", "b", "3", 5), (at(4), "exchange_org", "w", "a", "1", 6),
    ]
    return spark.createDataFrame(made, LOGIN)


def test_logins(some_logins):
    d = "2024-01-01"
    assert rows(logins.active_users(some_logins)) == [(d, "1", 2), (d, "3", 1)]
    assert rows(logins.user_days(some_logins), "user_id", "org_id", "p_c") == [("u", "c", "2"), ("v", "", "1"), ("w", "a", "1")]
    assert rows(logins.switch_counts(some_logins)) == [(d, "1", 1), (d, "3", 1), (d, "a", 2)]
    assert rows(logins.org_users(some_logins)) == [(d, "a", 3), (d, "b", 2), (d, "c", 1)]
    assert (logins.login_log(some_logins).count(), logins.switch_log(some_logins).count()) == (3, 3)
    assert rows(logins.latest_logins(some_logins.union(some_logins)), "org_id", "user_id", "p_c")[0] == ("a", "u", "1")


def test_login_lines(spark):
    lines = ["1.1.1.1^A1.5^A^A/log_login?event_name=login_org&org_id=o&l_t=2&c_t=pc&&p_c=1&t=1594095636000&uid=u", "1.1.1.1^A1^A^A/log_login?event_name=login_org&t=x"]
    r = logins.from_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(x.user_id, x.login_type, x.phone, x.login_host, x.ts) for x in r] == [("u", "2", None, "1.1.1.1", datetime(2020, 7, 7, 4, 20, 36))]


def test_ads(spark):
    lines = ["1704096000000 p c 1 7", "1704096000000 p c x 7", "1704096000000 p c 1", ""]
    assert rows(ads.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))) == [(datetime(2024, 1, 1, 8), "p", "c", 1, 7)]
    clicks = spark.createDataFrame([(START, "p", "c", u, a) for u, a, n in ((1, 1, 3), (2, 2, 3), (3, 3, 2), (4, 4, 1)) for _ in range(n)], sources.AD_CLICK)
    assert rows(ads.heavy_users(ads.user_counts(clicks), 3)) == [(1,), (2,)]
    assert rows(ads.province_top(ads.running_counts(clicks)), "ad_id", "rank") == [(1, 1), (2, 2), (3, 3)]
    assert ads.trend(clicks, "60 minutes", "10 seconds").filter("ad_id = 4").count() == 360


def test_basics(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(json.dumps({"name": n, "age": a, "depId": d, "gender": g, "salary": s}) for n, a, d, g, s in (("a", 25, 1, "m", 10), ("b", 35, 1, "m", 20), ("c", 20, 1, "f", 5))))
    staff = sources.json_lines(spark, str(tmp_path / "e.json"), sources.EMPLOYEE)
    departments = spark.createDataFrame([(1, "d")], sources.DEPARTMENT)
    assert rows(basics.department_averages(staff, departments)) == [("d", "m", 15.0, 30.0)]
    assert rows(basics.older_than(staff), "name") == [("b",)]
    assert sorted(sources.json_lines(spark, str(tmp_path / "e.json")).columns) == sorted(staff.columns)
    assert rows(basics.word_count(spark.createDataFrame([Row(value="a b  c"), Row(value="a"), Row(value=None)], "value string"))) == [("", 1), ("a", 2), ("b", 1), ("c", 1)]


def test_registered_functions(spark):
    register(spark)
    r = spark.sql("select concat_long_string(1, ':', 'x'), json_text('{\"a\": 0}', 'a'), remove_prefix(hash_prefix('a_b', 3)), get_json_object('{\"a\": 1}', '$.a')").first()
    assert tuple(r) == ("1:x", "0", "a_b", "1")


def test_generators(spark):
    made = sources.generated_actions(spark, 50)
    assert made.columns == sources.ACTION_COLUMNS
    assert rows(made.select("session_id", "page_id", "action_time")) == rows(sources.generated_actions(spark, 50).select("session_id", "page_id", "action_time"))
    assert made.filter(X.parse_time("action_time").isNull()).count() == 0


def test_top_n_keeps_a_bounded_window(spark, sf_dir):
    plan = products.top_products(products.area_counts(spark.createDataFrame([(0, 1)], "city_id long, product_id long"), sources.city_info(spark, sf_dir)), sources.product_info(spark, sf_dir))
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
