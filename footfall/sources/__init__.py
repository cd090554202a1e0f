"""Readers: files, catalog tables, JDBC, streams, and the logical tables over the star schema's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTION_COLUMNS = ["date", "user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id", "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids", "city_id"]
EMPLOYEE = T.StructType().add("name", "string").add("age", "long").add("depId", "long").add("gender", "string").add("salary", "long")
DEPARTMENT = T.StructType().add("id", "long").add("name", "string")
AD_CLICK = T.StructType().add("ts", "timestamp").add("province", "string").add("city", "string").add("user_id", "long").add("ad_id", "long")


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as `value`; a path may be a file, a folder or a glob."""
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; a schema saves the pass that infers one."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table over JDBC; partition is (column, lower, upper, how many) for a parallel read."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        reader = reader.options(**dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True)))
    return reader.load()


def kafka(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """A stream of `value` texts from comma-separated topics; needs Spark's Kafka package."""
    stream = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics} | options)
    return stream.load().select(F.col("value").cast("string").alias("value"))


def text_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of lines from files that arrive in a folder."""
    return spark.readStream.options(**options).text(path)


def parquet_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of rows from Parquet files; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path)


def generated_clicks(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """A stream of made-up ad messages, for trying things out."""
    n = F.col("value")
    parts = [F.unix_millis("timestamp"), F.concat(F.lit("province"), n % 5), F.concat(F.lit("city"), n % 10), F.pmod(F.xxhash64(n), F.lit(1000)), F.pmod(F.xxhash64(n, F.lit(1)), F.lit(10))]
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.concat_ws(" ", *parts).alias("value"))


def generated_actions(spark: SparkSession, sessions: int = 1000, most: int = 20, seed: int = 1) -> DataFrame:
    """A made-up action table with the columns of ACTION_COLUMNS; a seed gives the same rows on every run."""
    h = lambda salt, n: F.pmod(F.xxhash64("s", "i", F.lit(salt), F.lit(seed)), F.lit(n))
    base = spark.range(sessions).withColumnRenamed("id", "s")
    base = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64("s", F.lit(seed)), F.lit(most)))))
    kind, category, product = h("kind", 4), h("category", 100), h("product", 100)
    made = {
        "date": F.lit("2024-01-01"), "user_id": F.pmod(F.xxhash64("s"), F.lit(100)), "session_id": F.md5(F.col("s").cast("string")), "page_id": h("page", 10),
        "action_time": F.format_string("2024-01-01 %d:%02d:%02d", F.pmod(F.xxhash64("s", F.lit("hour")), F.lit(23)), h("minute", 60), h("second", 60)),
        "search_keyword": F.when(kind == 0, F.concat(F.lit("keyword"), h("word", 10))), "click_category_id": F.when(kind == 1, category), "click_product_id": F.when(kind == 1, product),
        "order_category_ids": F.when(kind == 2, category.cast("string")), "order_product_ids": F.when(kind == 2, product.cast("string")),
        "pay_category_ids": F.when(kind == 3, category.cast("string")), "pay_product_ids": F.when(kind == 3, product.cast("string")), "city_id": h("city", 10),
    }
    return base.select(*[made[c].alias(c) for c in ACTION_COLUMNS])


def between_dates(actions: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= date <= end; a bound that is None isn't one."""
    if start:
        actions = actions.filter(F.col("date") >= start)
    return actions.filter(F.col("date") <= end) if end else actions


# the logical tables over the star schema


def user_visit_action(spark: SparkSession, sf_dir: str, by_month: bool = False) -> DataFrame:
    """Actions from `events`: a session is a user's day, or all that a user did."""
    k = F.get_json_object("props", "$.k").cast("long")
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    date = F.date_format("ts", "yyyy-MM-dd")
    on = lambda what, value: F.when(kind == what, value)
    made = {
        "date": date, "user_id": F.col("user_id"), "session_id": F.col("user_id").cast("string") if by_month else F.concat(F.col("user_id").cast("string"), F.lit("_"), date),
        "page_id": F.col("event_id") % 10, "action_time": ts, "search_keyword": on("view", F.concat(F.lit("kw"), (k % 10).cast("string"))),
        "click_category_id": on("click", k % 20), "click_product_id": on("click", k),
        "order_category_ids": on("signup", F.concat((k % 20).cast("string"), F.lit(","), ((k + 7) % 20).cast("string"))), "order_product_ids": on("signup", k.cast("string")),
        "pay_category_ids": on("purchase", (k % 20).cast("string")), "pay_product_ids": on("purchase", k.cast("string")), "city_id": F.col("user_id") % 25,
    }
    return parquet(spark, sf_dir, "events").select("event_id", *[made[c].alias(c) for c in ACTION_COLUMNS])


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, nations = parquet(spark, sf_dir, "customer"), parquet(spark, sf_dir, "nation")
    users = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return users.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_name").alias("name"), (18 + F.col("c_custkey") % 50).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"), F.col("n_name").alias("city"), F.when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("sex"),
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, regions = parquet(spark, sf_dir, "nation"), parquet(spark, sf_dir, "region")
    cities = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    return cities.select(F.col("n_nationkey").cast("long").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("area"))


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.concat(F.lit('{"product_status": '), (F.col("p_partkey") % 2).cast("string"), F.lit("}"))
    return parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), status.alias("extend_info"))


def ad_clicks(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """AD_CLICK rows from the click events, or a stream of them: the user's region and nation, and one of ten ads."""
    events = (parquet(spark, sf_dir, "events") if events is None else events).filter("event_type = 'click'")
    places = parquet(spark, sf_dir, "customer").join(city_info(spark, sf_dir), F.col("c_nationkey") == F.col("city_id")).select("c_custkey", "area", "city_name")
    ad = F.get_json_object("props", "$.k").cast("long") % 10
    return events.join(places, F.col("user_id") == F.col("c_custkey")).select(F.col("ts").cast("timestamp").alias("ts"), F.col("area").alias("province"), F.col("city_name").alias("city"), "user_id", ad.alias("ad_id"))


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, event, user_id, org_id, p_c, event_id): views and clicks are logins, signups switch the organisation."""
    events = parquet(spark, sf_dir, "events").filter("event_type in ('view', 'click', 'signup')")
    k = F.get_json_object("props", "$.k").cast("long")
    event = F.when(F.col("event_type") == "signup", "exchange_org").otherwise("login_org")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), event.alias("event"), "user_id", (k % 25).cast("string").alias("org_id"), (k % 3 + 1).cast("string").alias("p_c"))
