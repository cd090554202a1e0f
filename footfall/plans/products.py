"""Popular products by area, skewed counts, averages and word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall import functions as X
from footfall import sources
from footfall.functions.registered import register
from footfall.operators import basics
from footfall.operators import products as ops
from footfall.plans import views
from footfall.sources import sinks


def top(spark: SparkSession, sf_dir: str, clicks: DataFrame) -> DataFrame:
    counts = ops.area_counts(clicks, sources.city_info(spark, sf_dir))
    return ops.top_products(counts, sources.product_info(spark, sf_dir), levels=ops.REGION_LEVELS)


def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = sources.user_visit_action(spark, sf_dir).select("city_id", F.col("click_product_id").alias("product_id"))
    return top(spark, sf_dir, clicks)


def b10_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of order lines: each line is a click of the customer's nation."""
    lines, orders, customers = (sources.parquet(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return top(spark, sf_dir, joined.select(F.col("c_nationkey").cast("long").alias("city_id"), F.col("l_partkey").alias("product_id")))


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as employees of their nations; the salary is in cents."""
    users = sources.parquet(spark, sf_dir, "customer")
    age, gender = 18 + F.col("c_custkey") % 50, F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female")
    return users.select(F.col("c_name").alias("name"), age.alias("age"), F.col("c_nationkey").cast("long").alias("depId"), gender.alias("gender"), F.round(F.col("c_acctbal") * 100).cast("long").alias("salary"))


def b24(spark: SparkSession, sf_dir: str) -> DataFrame:
    departments = sources.parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return basics.department_averages(employees(spark, sf_dir), departments)


def b25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines and read again under the fixed schema."""
    path = sinks.shared_folder(spark)
    sinks.save_json(basics.older_than(employees(spark, sf_dir)), path)
    return sources.json_lines(spark, path, sources.EMPLOYEE)


def u_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions in a SQL text."""
    register(spark)
    products, cities = sources.product_info(spark, sf_dir), sources.city_info(spark, sf_dir)
    return spark.sql(
        """select product_id, concat_long_string(product_id, ':', product_name) as label, json_text(extend_info, 'product_status') as status,
        remove_prefix(hash_prefix(product_name, 10)) as same_name, concat_long_string(city_id, ':', city_name) as city, level_of_area(element_at(array('China North', 'China South', 'West North', 'West', 'China East', 'China Middle', 'West South'), cast(city_id % 7 + 1 as int))) as level
        from {products} join {cities} on product_id % 25 = city_id""",
        products=products, cities=cities,
    )


def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sources.parquet(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_orderkey", "l_linenumber")
    counts = ops.salted_count(lines, ["l_returnflag"])
    return counts.join(ops.salted_distinct(lines, ["l_returnflag"], "l_partkey").withColumnRenamed("n", "parts"), "l_returnflag")


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three merges of last month's half of the action counts with the other half."""
    counts = lambda half: sources.user_visit_action(spark, sf_dir).filter(half).groupBy("date", "city_id").agg(F.count("*").alias("n"))
    old, new = counts(F.col("date") <= "2024-01-20"), counts(F.col("date") >= "2024-01-15")
    some = new.filter("city_id < 5")
    found = {"upsert": sinks.upsert(old, some, ["date", "city_id"]), "add": sinks.add_up(old, some, ["date", "city_id"], "n"), "replace": sinks.replace_groups(old, some, ["date"])}
    out = [df.select(F.lit(k).alias("merge"), "date", "city_id", "n") for k, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES = {
    "b10_area_top3_products": b10,
    "b10_area_top3_orders": b10_orders,
    "a22_salted_counts": salted,
    "b23_word_count": lambda s, d: basics.word_count(sources.parquet(s, d, "documents"), "text"),
    "b24_department_averages": b24,
    "b25_older_to_json": b25,
    "u_registered_functions": u_functions,
    "k_merges": merges,
}

RANKED = """t as (select area, case area when 'AMERICA' then 'A Level' when 'EUROPE' then 'A Level' when 'ASIA' then 'B Level' when 'MIDDLE EAST' then 'C Level' else 'D Level' end as area_level,
  c.product_id, click_count, city_infos, product_name, product_status, row_number() over (partition by area order by click_count desc, c.product_id) as rank
  from c join products p on c.product_id = p.product_id qualify rank <= 3) select * from t"""
COUNTED = "c as (select area, product_id, count(*) as click_count, string_agg(distinct city_id || ':' || city_name, ',' order by city_id || ':' || city_name) as city_infos from f group by all)"
STAFF = "staff as (select c_name as name, 18 + c_custkey % 50 as age, c_nationkey as depId, case when c_custkey % 2 = 0 then 'male' else 'female' end as gender, cast(round(c_acctbal * 100) as bigint) as salary from customer)"
HALVES = f"""with {views.actions()}, old as (select date, city_id, count(*) as n from actions where date <= '2024-01-20' group by all),
new as (select date, city_id, count(*) as n from actions where date >= '2024-01-15' and city_id < 5 group by all)"""
SQL = {
    "b10_area_top3_products": f"with {views.actions()}, {views.CITIES}, {views.PRODUCTS}, f as (select city_id, city_name, area, click_product_id as product_id from actions join cities using (city_id) where click_product_id is not null), {COUNTED}, {RANKED}",
    "b10_area_top3_orders": f"with {views.CITIES}, {views.PRODUCTS}, f as (select city_id, city_name, area, l_partkey as product_id from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join cities on c_nationkey = city_id), {COUNTED}, {RANKED}",
    "a22_salted_counts": "select l_returnflag, count(*) as n, count(distinct l_partkey) as parts from lineitem group by all",
    "b23_word_count": "select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) group by word",
    "b24_department_averages": f"with {STAFF} select n_name as department, gender, sum(salary) / count(*) as avg_salary, sum(age) / count(*) as avg_age from staff join nation on depId = n_nationkey where age > 20 group by all",
    "b25_older_to_json": f"with {STAFF} select * from staff where age > 30",
    "u_registered_functions": f"with {views.CITIES} select p_partkey as product_id, p_partkey || ':' || p_name as label, cast(p_partkey % 2 as varchar) as status, p_name as same_name, city_id || ':' || city_name as city, (['A', 'B', 'C', 'D', 'A', 'B', 'C'])[city_id % 7 + 1] || ' Level' as level from part join cities on p_partkey % 25 = city_id",
    "k_merges": f"""{HALVES} select 'upsert' as merge, * from old where (date, city_id) not in (select (date, city_id) from new) union all select 'upsert', * from new
union all select 'add', date, city_id, cast(sum(n) as bigint) from (select * from old union all select * from new) group by date, city_id
union all select 'replace', * from old where date not in (select date from new) union all select 'replace', * from new""",
}
