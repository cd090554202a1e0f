"""Web-log and login queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.operators import basics, logins, logs
from footfall.plans import views
from footfall.sources import sinks

#: Address ranges of the query: one of 8,000,000 addresses at each multiple of 9,000,000.
RANGES, STEP, WIDTH = 478, 9_000_000, 8_000_000
#: Tasks for each core that lines are made by.
TASKS_OF_CORE = 4


def address() -> Column:
    return F.pmod(F.col("event_id") * 7_919_001 + F.col("user_id") * 104_729, F.lit(2**32))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log lines; every tenth is broken.

    A line takes far more time than its event takes space, so events are dealt evenly before: a file's splits are few and uneven.
    """
    events = sources.parquet(spark, sf_dir, "events").repartition(TASKS_OF_CORE * spark.sparkContext.defaultParallelism, "event_id").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    name = F.expr("element_at(array('e_pv', 'e_e', 'e_cs', 'e_cr', 'e_crt', 'e_l'), cast(event_id % 6 + 1 as int))")
    query = F.concat(F.lit("?en="), name, F.lit("&u_ud="), F.col("user_id"), F.lit("&u_mid=&l=zh%2DCN&ip=spoofed&&tt=first&tt=t%3D"), F.col("event_type"), F.lit("&bad=%zz&flag"))
    parts = [logs.ip_text(address()), F.concat("t", F.lit(".573")), F.lit("host"), F.concat(F.lit("/log.gif"), F.when(F.col("event_id") % 10 == 0, "").otherwise(query))]
    return events.select(F.concat_ws("^A", *parts).alias("value"))


def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_fields(lines(spark, sf_dir))


def log_fields(lines: DataFrame) -> DataFrame:
    m = logs.parsed(lines)
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return m.select(*[get(k) for k in ("ip", "s_time", "en", "u_ud", "u_mid", "l", "tt", "bad")], logs.event_name(F.col("m")["en"]).alias("event"), F.size("m").alias("n_fields"))


#: Regions of the address ranges in turn, and what country, province and city they tell.
REGIONS = (
    ("江苏省南京市", "中国", "江苏省", "南京市"), ("内蒙古呼和浩特市", "中国", "内蒙古自治区", "呼和浩特市"), ("广西桂林市", "中国", "广西", "桂林市"), ("北京市海淀区", "中国", "北京市", "海淀区"),
    ("香港", "中国", "香港特别行政区", "unknown"), ("局域网", "中国", "上海市", "unknown"), ("美国", "unknown", "unknown", "unknown"), ("浙江省", "中国", "浙江省", "unknown"),
)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines with a browser's name in two of three."""
    number = F.regexp_extract("value", r"&u_ud=(\d+)", 1).try_cast("int")
    chrome = F.format_string("Mozilla/5.0 (Windows NT %d.0) AppleWebKit/537 (KHTML, like Gecko) Chrome/%d.0 Safari/537", number % 5 + 6, number % 40 + 60)
    firefox = F.format_string("Mozilla/5.0 (X11; Linux x86_64; rv:%d.0) Gecko/20100101 Firefox/%d.0", number % 40, number % 40)
    agent = F.when(number % 3 == 0, chrome).when(number % 3 == 1, firefox)
    return lines(spark, sf_dir).select(F.concat("value", F.coalesce(F.concat(F.lit("&b_iev="), F.url_encode(agent)), F.lit(""))).alias("value"))


def places(spark: SparkSession) -> DataFrame:
    names = F.array(*[F.lit(r[0]) for r in REGIONS])
    return ranges(spark).withColumn("region", F.get(names, (F.col("start_ip") / STEP % len(REGIONS)).cast("int")))


def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parsed(lines(spark, sf_dir)).select(logs.row_key("m").alias("row_key"), logs.row_key("m", "e_e").alias("old_row_key"))


def ranges(spark: SparkSession) -> DataFrame:
    start = F.col("id") * STEP
    return spark.range(RANGES).select(start.alias("start_ip"), (start + WIDTH - 1).alias("end_ip"), F.concat(F.lit("region "), F.col("id")).alias("region"))


def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sources.parquet(spark, sf_dir, "events").select("event_id", logs.ip_text(address()).alias("ip"))
    return logs.located(events, ranges(spark))


def b16_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(logs.enriched(visits(spark, sf_dir), places(spark)))


def b16_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched lines put into a store by row key; then page views are put again without their browser, and the store is read."""
    folder = sinks.shared_folder(spark)
    logs.enriched(visits(spark, sf_dir), places(spark)).write.parquet(folder)
    found = spark.read.schema("row_key string, m map<string, string>").parquet(folder)  # lines are read once for both batches
    table = logs.store(spark, sinks.shared_folder(spark))
    logs.save(found, table, 0)
    again = found.filter(F.try_element_at("m", F.lit("en")) == "e_pv")
    logs.save(again.withColumn("m", F.map_filter("m", lambda k, v: ~k.isin("browser", "browser_v"))), table, 1)
    return named(table.latest(["row_key"]))


def named(found: DataFrame) -> DataFrame:
    names = ("ip", "s_time", "en", "u_ud", "l", "tt", "country", "province", "city", "browser", "browser_v", "os", "os_v")
    return found.select("row_key", *[F.try_element_at("m", F.lit(k)).alias(k) for k in names], F.size("m").alias("n_fields"))


def from_text(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines (`value`) written as text files and read again."""
    folder = sinks.shared_folder(spark)
    lines.write.text(folder)
    return sources.text_lines(spark, folder)


def login_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logins as log lines."""
    row = sources.logins(spark, sf_dir)
    query = F.concat(F.lit("/log_login?event_name="), "event", F.lit("&org_id="), "org_id", F.lit("&l_t=2&&p_c="), "p_c", F.lit("&t="), F.unix_millis("ts"), F.lit("&uid="), "user_id")
    return row.select(F.concat_ws("^A", F.lit("10.0.0.1"), F.unix_seconds("ts").cast("string"), F.lit(""), query).alias("value"))


def t_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_fields(from_text(spark, lines(spark, sf_dir)))


def t_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logins.active_users(logins.from_lines(from_text(spark, login_lines(spark, sf_dir))))


def t_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sources.parquet(spark, sf_dir, "part").filter("p_name is not null").select(F.col("p_name").alias("value"))
    return basics.word_count(from_text(spark, names))


def timed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: X.time_text(c) for c in columns})


def of_logins(f, *times: str):
    return lambda s, d: timed(f(sources.logins(s, d)), *times)


QUERIES = {
    "b16_log_fields": b16,
    "s1_text_log_fields": t_fields,
    "s1_text_active_users": t_users,
    "s1_text_word_count": t_words,
    "b16_log_enriched": b16_enriched,
    "b16_log_stored": b16_stored,
    "b17_row_keys": b17,
    "j7_ip_ranges": j7,
    "b18_active_users": of_logins(logins.active_users),
    "b19_user_days": of_logins(logins.user_days, "exchange_time"),
    "b20_switch_counts": of_logins(logins.switch_counts),
    "b21_org_users": of_logins(logins.org_users),
    "b22_login_log": of_logins(logins.login_log, "ts"),
    "b22_switch_log": of_logins(logins.switch_log, "exchange_time"),
    "b26_switches_by_platform": of_logins(logins.switches_by_platform),
    "b27_latest_logins": of_logins(logins.latest_logins, "last_login_time"),
}

ADDRESS = "(event_id * 7919001 + user_id * 104729) % 4294967296"
IP = f"(n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255)"
EVENT = "case event_id % 6 " + " ".join(f"when {i} then '{logs.EVENTS[k]}'" for i, k in enumerate(("e_pv", "e_e", "e_cs", "e_cr", "e_crt", "e_l"))) + " end"
ALIAS = "case event_id % 6 when 0 then 'e_pv' when 1 then 'e_e' when 2 then 'e_cs' when 3 then 'e_cr' when 4 then 'e_crt' else 'e_l' end"
TIME = "strftime({}, '%Y-%m-%d %H:%M:%S')"
WITH = f"with {views.LOGINS}"
#: The checksum of a text `s`, byte by byte from the table of its 256 steps.
STEPS = """bits as (select i, i as c, 0 as k from range(256) as t(i) union all select i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 from bits where k < 8),
steps as (select list(c order by i) as tab from bits where k = 8)"""
CHECKSUM = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda x: cast(ord(x) as bigint))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 100000000"
KEY = f"cast(epoch_us(ts) // 1000000 * 1000 + 573 as varchar) || '_' || {CHECKSUM}"
SQL = {
    "s1_text_word_count": "select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by word",
    "b16_log_fields": f"""select {IP} as ip, cast(epoch_us(ts) // 1000000 * 1000 + 573 as varchar) as s_time, {ALIAS} as en, cast(user_id as varchar) as u_ud, null::varchar as u_mid,
'zh-CN' as l, 't=' || event_type as tt, null::varchar as bad, {EVENT} as event, 6 as n_fields from (select *, {ADDRESS} as n from events) where event_id % 10 <> 0""",
    "b16_log_enriched": f"""with recursive {STEPS}, r as (select * from (values {', '.join(f"({i}, '{c}', '{p}', '{t}')" for i, (_, c, p, t) in enumerate(REGIONS))}) as t(rid, country, province, city)),
e as (select *, {ADDRESS} as n from events where event_id % 10 <> 0)
select {KEY.format(s=f"user_id || {ALIAS}")} as row_key, {IP} as ip, cast(epoch_us(ts) // 1000000 * 1000 + 573 as varchar) as s_time, {ALIAS} as en, cast(user_id as varchar) as u_ud, 'zh-CN' as l, 't=' || event_type as tt,
coalesce(country, 'unknown') as country, coalesce(province, 'unknown') as province, coalesce(city, 'unknown') as city,
case user_id % 3 when 0 then 'Chrome' when 1 then 'Firefox' end as browser, case user_id % 3 when 0 then (user_id % 40 + 60) || '.0' when 1 then (user_id % 40) || '.0' end as browser_v,
case user_id % 3 when 0 then 'Windows' when 1 then 'Linux' end as os, case user_id % 3 when 0 then 'Windows NT ' || (user_id % 5 + 6) || '.0' when 1 then 'Linux' end as os_v,
case when user_id % 3 = 2 then 9 else 14 end as n_fields from e cross join steps left join r on n % {STEP} < {WIDTH} and n // {STEP} % {len(REGIONS)} = rid""",
    "b17_row_keys": f"""with recursive {STEPS} select {KEY.format(s=f"user_id || {ALIAS}")} as row_key, {KEY.format(s="user_id || 'e_e'")} as old_row_key from events cross join steps where event_id % 10 <> 0""",
    "j7_ip_ranges": f"select event_id, {IP} as ip, case when n % {STEP} < {WIDTH} then 'region ' || (n // {STEP}) end as region from (select event_id, {ADDRESS} as n from events)",
    "b18_active_users": f"{WITH} select date, p_c, count(distinct user_id) as users from logins where event = 'login_org' group by all",
    "b19_user_days": f"""{WITH}, x as (select *, row_number() over (partition by date, user_id order by (event = 'exchange_org') desc, ts desc, event_id desc) as last_n,
row_number() over (partition by date, user_id order by ts, event_id) as first_n from logins)
select a.date, a.user_id, case when a.event = 'exchange_org' then a.org_id else '' end as org_id, case when a.event = 'exchange_org' then a.p_c else b.p_c end as p_c,
case when a.event = 'exchange_org' then {TIME.format('a.ts')} end as exchange_time from x a join x b on a.date = b.date and a.user_id = b.user_id and b.first_n = 1 where a.last_n = 1""",
    "b20_switch_counts": f"""{WITH}, s as (select date, user_id, bool_or(event = 'exchange_org') as switched from logins group by all)
select date, p_c as key, count(*) as n from logins join s using (date, user_id) where not switched group by all union all select date, 'a', count(*) from s where switched group by all""",
    "b21_org_users": f"{WITH} select date, org_id, count(distinct user_id) as users from logins group by all",
    "b22_login_log": f"{WITH} select event_id, {TIME.format('ts')} as ts, user_id, org_id, p_c from logins where event = 'login_org'",
    "b22_switch_log": f"{WITH} select user_id, org_id, {TIME.format('ts')} as exchange_time from logins where event = 'exchange_org'",
    "b26_switches_by_platform": f"{WITH} select date, org_id, p_c, count(*) as n from logins where event = 'exchange_org' group by all",
    "b27_latest_logins": f"{WITH} select date, org_id, user_id, p_c, {TIME.format('ts')} as last_login_time from logins qualify row_number() over (partition by date, org_id, user_id order by ts desc, event_id desc) = 1",
}
SQL |= {"s1_text_log_fields": SQL["b16_log_fields"], "s1_text_active_users": SQL["b18_active_users"]}
SQL["b16_log_stored"] = f"""select * replace (case when en <> 'e_pv' then browser end as browser, case when en <> 'e_pv' then browser_v end as browser_v,
case when en = 'e_pv' and browser is not null then n_fields - 2 else n_fields end as n_fields) from ({SQL['b16_log_enriched']})"""
