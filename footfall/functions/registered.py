"""Functions for use in SQL texts: SQL expressions under names, which the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and body; none takes a built-in function's name.
FUNCTIONS = {
    "concat_long_string": ("n bigint, separator string, s string", "concat(cast(n as string), separator, s)"),
    "json_text": ("json string, name string", "get_json_object(json, concat('$.', name))"),
    "hash_prefix": ("s string, n int", "concat(cast(pmod(xxhash64(s), n) as string), '_', s)"),
    "remove_prefix": ("s string", "regexp_replace(s, '^[^_]*_', '')"),
    "level_of_area": ("area string", "case when area in ('China North', 'China East') then 'A Level' when area in ('China South', 'China Middle') then 'B Level' when area in ('West North', 'West South') then 'C Level' else 'D Level' end"),
}


def register(spark: SparkSession) -> None:
    for name, (params, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns string return {body}")
