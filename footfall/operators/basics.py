"""Word count and the employee tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tokens between single spaces, empty ones included."""
    return lines.select(F.explode(F.split(column, " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def department_averages(employees: DataFrame, departments: DataFrame, over_age: int = 20) -> DataFrame:
    """Average salary and age by department and gender of those over an age."""
    some = employees.filter(F.col("age") > over_age).join(departments.withColumnRenamed("name", "department"), F.col("depId") == F.col("id"))
    return some.groupBy("department", "gender").agg(F.avg("salary").alias("avg_salary"), F.avg("age").alias("avg_age"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of a schema: in its order, cast where that is safe, missing ones null, others gone."""
    return df.to(schema)


def older_than(employees: DataFrame, age: int = 30) -> DataFrame:
    return employees.filter(F.col("age") > age)
