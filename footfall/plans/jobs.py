"""What a job is put together from, on the given tables: tasks, globs, counters, saved tables and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall import functions as X
from footfall import sources
from footfall.operators import basics, logs
from footfall.operators import sessions as ops
from footfall.params import task
from footfall.plans import sessions, views
from footfall.plans.logs import lines
from footfall.plans.products import employees
from footfall.sources import sinks

TASK = 7


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each nation: the sessions of men of twelve years of age."""
    key = F.col("n_nationkey")
    one = lambda c: F.array(c.cast("string"))
    param = F.to_json(F.struct(one(18 + key).alias("startAge"), one(30 + key).alias("endAge"), one(F.lit("male")).alias("sex")))
    return sources.parquet(spark, sf_dir, "nation").select(key.cast("long").alias("task_id"), F.col("n_name").alias("task_name"), param.alias("task_param"))


def task_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that one task of the task table asks for."""
    return sessions.flat(ops.filtered(sessions.all_sessions(spark, sf_dir), task(tasks(spark, sf_dir), TASK)))


def glob_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines by event from the folders of some days, named by a glob."""
    folder, found = sinks.shared_folder(spark), lines(spark, sf_dir)
    day = X.date_key(F.timestamp_millis(X.server_millis(F.get(F.split("value", r"\^A"), F.lit(1)))))
    found.withColumn("day", day).write.partitionBy("day").text(folder)
    some = sources.text_lines(spark, f"{folder}/day=2024010[1-7]/part-*")
    return logs.parsed(some).select(logs.event_name(F.col("m")["en"]).alias("event")).groupBy("event").agg(F.count("*").alias("n"))


def dropped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines were read and how many dropped while the others were written: one row."""
    counted = Observation("lines")
    logs.parsed(lines(spark, sf_dir), counted).write.parquet(sinks.shared_folder(spark))
    return spark.createDataFrame([(counted.get["lines"], counted.get["dropped"])], "lines long, dropped long")


def saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions by day and city in a table of the catalog, in two appends."""
    counts = sources.user_visit_action(spark, sf_dir).groupBy("date", "city_id").agg(F.count("*").alias("n"))
    name, path = f"actions_{uuid.uuid4().hex}", sinks.shared_folder(spark)
    for half in ("city_id < 10", "city_id >= 10"):
        sinks.save_table(counts.filter(half), name, path)
    return spark.table(name)


STAFF = T.StructType().add("name", "string").add("salary", "double").add("age", "integer").add("team", "string")


def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employees under another schema: fewer columns in another order, a wider type, one that they don't have."""
    return basics.conform(employees(spark, sf_dir).withColumn("age", F.col("age").cast("int")), STAFF)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sessions as a saved report has them."""
    folder = sinks.shared_folder(spark)
    sessions.save_report(spark, sf_dir, folder)
    return spark.read.parquet(f"{folder}/top_sessions")


def days_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = lambda day: F.datediff(day.cast("date"), F.col("ts").cast("date"))
    return sources.parquet(spark, sf_dir, "events").select("event_id", age(X.today()).alias("to_today"), age(X.yesterday()).alias("to_yesterday"))


def random_salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random salts and ids of order lines: what is always so of them."""
    salted = X.with_prefix(F.col("l_returnflag"), 10)
    found = sources.parquet(spark, sf_dir, "lineitem").select("l_returnflag", salted.alias("salted"), F.uuid().alias("id"))
    same = F.min(X.without_prefix("salted") == F.col("l_returnflag"))
    return found.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("salted").alias("salts"), same.alias("same"))


QUERIES = {
    "s12_task_sessions": task_sessions,
    "s2_glob_lines": glob_lines,
    "a21_dropped_lines": dropped_lines,
    "k7_saved_table": saved_table,
    "p17_conformed": conformed,
    "c1_saved_report": report,
    "x11_days_ago": days_ago,
    "x33_random_salts": random_salts,
}

NAMES = "case event_id % 6 " + " ".join(f"when {i} then '{logs.EVENTS[k]}'" for i, k in enumerate(("e_pv", "e_e", "e_cs", "e_cr", "e_crt", "e_l"))) + " end"
SQL = {
    "s12_task_sessions": f"{views.sessions()} select {sessions.COLUMNS} from sessions where sex = 'male' and age between {18 + TASK} and {30 + TASK}",
    "s2_glob_lines": f"select {NAMES} as event, count(*) as n from events where event_id % 10 <> 0 and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-08' group by all",
    "a21_dropped_lines": "select count(*) as lines, count(*) filter (event_id % 10 = 0) as dropped from events",
    "k7_saved_table": f"with {views.actions()} select date, city_id, count(*) as n from actions group by all",
    "p17_conformed": "select c_name as name, cast(cast(round(c_acctbal * 100) as bigint) as double) as salary, cast(18 + c_custkey % 50 as integer) as age, cast(null as varchar) as team from customer",
    "c1_saved_report": sessions.SQL["b7_top_category_sessions"],
    "x11_days_ago": "select event_id, cast(date_diff('day', cast(ts as date), current_date) as integer) as to_today, cast(date_diff('day', cast(ts as date), current_date) - 1 as integer) as to_yesterday from events",
    "x33_random_salts": "select l_returnflag, count(*) as n, count(*) as ids, 10 as salts, true as same from lineitem group by all",
}
