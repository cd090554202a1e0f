"""Popular products by area, and counts of skewed keys in two steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from footfall import functions as X

#: The level of an area; every other area is of level D.
LEVELS = {"China North": "A Level", "China East": "A Level", "China South": "B Level", "China Middle": "B Level", "West North": "C Level", "West South": "C Level"}
#: The same grades for the regions of the star schema.
REGION_LEVELS = {"AMERICA": "A Level", "EUROPE": "A Level", "ASIA": "B Level", "MIDDLE EAST": "C Level"}


def level_of(area: str, levels: dict[str, str]) -> Column:
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, level in levels.items():
        found = found.when(F.col(area) == name, level)
    return found.otherwise("D Level")


def status_of(extend_info: str) -> Column:
    status = X.json_field(extend_info, "product_status")
    return F.when(status == "0", "Self").otherwise("Third Party")


def area_counts(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """(area, product_id, click_count, city_infos): clicks are (city_id, product_id).

    Clicks are first counted by city, so the city join sees counts and not clicks, and every list has
    the cities of one area at most.
    """
    counted = clicks.filter("product_id is not null").groupBy("city_id", "product_id").agg(F.count("*").alias("n"))
    joined = counted.join(cities, "city_id").withColumn("info", X.labelled("city_id", "city_name"))
    return joined.groupBy("area", "product_id").agg(F.sum("n").alias("click_count"), X.distinct_list("info").alias("city_infos"))


def top_products(counts: DataFrame, products: DataFrame, n: int = 3, levels: dict[str, str] | None = None) -> DataFrame:
    """The n products with most clicks in each area, ties by product; products without a record drop out first."""
    known = counts.join(products, "product_id")
    rank = F.row_number().over(W.partitionBy("area").orderBy(F.desc("click_count"), "product_id"))
    top = known.withColumn("rank", rank).filter(F.col("rank") <= n)
    return top.select("area", level_of("area", LEVELS if levels is None else levels).alias("area_level"), "product_id", "click_count", "city_infos", "product_name", status_of("extend_info").alias("product_status"), "rank")


def salted_count(df: DataFrame, keys: list[str], salts: int = 10, by: str | None = None) -> DataFrame:
    """Counts by `keys` in two steps: by key and salt, then by key.

    Spark adds up within tasks before it shuffles, so a count alone needs no salt; it helps where the
    first step keeps sets or lists. The salt is a hash of `by`, or of all columns.
    """
    salt = F.pmod(F.xxhash64(*([by] if by else df.columns)), F.lit(salts)).alias("salt")
    return df.groupBy(*keys, salt).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def salted_distinct(df: DataFrame, keys: list[str], value: str, salts: int = 10) -> DataFrame:
    """Different values by `keys`; a salt of the value itself deals a large key's set over tasks."""
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).alias("salt")
    parts = df.groupBy(*keys, salt).agg(F.count_distinct(value).alias("n"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))
