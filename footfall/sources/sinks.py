"""Writers and merges: appends, upserts as DataFrame functions, and tables that grow by batch folders."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the place that driver and executors share, which spark.checkpoint.dir names.

    A folder that the context was given counts too. Where neither is set, a temporary folder serves a local
    session; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base}/{uuid.uuid4().hex}"


#: Rows of a file, about, of a stream's input.
FILE_ROWS = 250_000


def by_part(df: DataFrame, part: Column, path: str) -> DataFrame:
    """df written with a folder for each value of `part`, and read again, with the column `part of`."""
    rows = df.withColumn("part of", part)
    rows.write.partitionBy("part of").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def files_of_parts(rows: DataFrame, most: int = FILE_ROWS) -> int:
    """How many files of about `most` rows the largest part needs."""
    largest = rows.groupBy("part of").count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-largest // most))


def in_files(df: DataFrame, path: str, n: int) -> None:
    """A folder of exactly n files, written by as many tasks; files without rows make up the number."""
    spark = df.sparkSession
    df.repartition(n).write.parquet(path)
    for _ in range(n - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
        spark.createDataFrame([], df.schema).write.mode("append").parquet(path)


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet files added to a folder, one subfolder for each value of `by`."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    """Rows added to a table over JDBC in batches; errors are raised."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def save_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """A table of the session's catalog, in the warehouse or in a folder of its own."""
    writer = df.write.mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new, which replace those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def add_up(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): the values of old and new added by key."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """old without the groups that new has any row of, and new."""
    return upsert(old, new, group)


def to_console(df: DataFrame, rows: int = 20):
    """Shows a table's rows, or starts a query that shows each micro-batch of a stream."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", rows).outputMode("update").start()
    return df.show(rows, truncate=False)


def put_rows(df: DataFrame, table: Batches, batch: int, ties: list[str]) -> None:
    """Rows for a store with one row a key, as one batch; of rows with equal keys the greatest by `ties` is put."""
    order = F.struct(*[F.col(c) for c in ties])
    names = [c for c in table.schema.fieldNames() if c not in table.keys]
    one = df.groupBy(*table.keys).agg(F.max_by(F.struct(*names), order).alias("row"))
    table.write(one.select(*table.keys, "row.*"), batch)


class Batches:
    """A table as one folder of Parquet files for each micro-batch.

    A batch overwrites its own folder only, so a batch that is run again after a failure leaves the
    same rows. What a batch writes is in proportion to the batch; readers merge: they add up (`summed`)
    or take a key's latest rows (`latest`).

    With `keys`, after every `every` batches what has come since the last merge is merged into the parts that it
    touches (added up if a `value` is named, else each key's latest rows). A part is a value of the column
    `part`, or of the expression `part_of` under that name; keys decide their part. It has a folder `merged/part=x/upto=n`,
    and parts that nothing has come for keep the folder they have. A merge counts once its mark is
    written; readers take each part's last folder that counts and the batches after the last merge, at most `every` small
    ones. What no reader and no repeated batch needs any more is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str] | None = None, value: str | None = None, part: str | None = None, part_of: str = "0", every: int = 100) -> None:
        self.spark, self.path, self.schema = spark, path, T._parse_datatype_string(schema)
        self.keys, self.value, self.every = keys, value, every
        self.part = part or "part"
        self.part_of = self.part if self.part in self.schema.fieldNames() else part_of
        self.with_batch = T.StructType([*self.schema.fields]).add("batch", "long")
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.write(spark.createDataFrame([], self.schema), -1)

    def folders(self, kind: str) -> list[int]:
        """The numbers of the complete folders `kind=n`, in order."""
        names = [s.getPath().getName() for s in self.files.listStatus(self.root)]
        found = sorted(int(x.removeprefix(f"{kind}=")) for x in names if x.startswith(f"{kind}="))
        return [n for n in found if self.files.exists(self.root.suffix(f"/{kind}={n}/_SUCCESS"))]

    def parts(self) -> dict[str, list[int]]:
        """The numbers of each part's folders, in order, by the part's folder name."""
        found: dict[str, list[int]] = {}
        for s in self.files.globStatus(self.root.suffix("/merged/*/upto=*")) or []:
            found.setdefault(s.getPath().getParent().getName(), []).append(int(s.getPath().getName().removeprefix("upto=")))
        return {k: sorted(v) for k, v in found.items()}

    def write(self, df: DataFrame, batch: int) -> None:
        df.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if self.keys and batch >= 0 and (batch + 1) % self.every == 0:
            self.compact(batch)

    def compact(self, batch: int) -> None:
        """Merges the batches since the last merge, up to this one, into the parts that they touch."""
        before = max([n for n in self.folders("upto") if n < batch], default=-2)
        new = self.in_batches(before, batch + 1).withColumn("part of", F.expr(self.part_of).cast("string"))
        touched = [r["part of"] for r in new.select("part of").distinct().collect()]
        rows = new.drop("part of").unionByName(self.merged(before, touched))
        if self.value:
            rows = rows.groupBy(*self.keys).agg(F.sum(self.value).alias(self.value), F.max("batch").alias("batch"))
        else:
            rows = self.last(rows, self.keys)
        placed = rows.select(*self.with_batch.fieldNames(), *([] if self.part in self.schema.fieldNames() else [F.expr(self.part_of).cast("string").alias(self.part)]), F.lit(batch).alias("upto"))
        writer = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(self.part, "upto").parquet(f"{self.path}/merged")
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.path}/upto={batch}")
        gone = [f"batch={n}" for n in self.folders("batch") if 0 <= n <= before] + [f"upto={n}" for n in self.folders("upto") if n < before]
        for name, numbers in self.parts().items():
            needed = max([n for n in numbers if n <= before], default=-2)
            gone += [f"merged/{name}/upto={n}" for n in numbers if n < needed]
        for name in gone:
            self.files.delete(self.root.suffix(f"/{name}"), True)

    def merged(self, upto: int, touched: list[str | None] | None = None) -> DataFrame:
        """The merged rows as the merge `upto` left them: all, or of some parts."""
        names = {k: [n for n in v if n <= upto] for k, v in self.parts().items()}
        paths = [f"{self.path}/merged/{k}/upto={v[-1]}" for k, v in names.items() if v]
        own = self.part in self.schema.fieldNames()
        schema = self.with_batch if own else T.StructType([*self.with_batch.fields]).add(self.part, "string")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/merged").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if touched is not None:
            part = F.col(self.part).cast("string")
            rows = rows.filter(part.isin([t for t in touched if t is not None]) | (part.isNull() if None in touched else F.lit(False)))
        return rows.select(*self.with_batch.fieldNames())

    def in_batches(self, after: int, before: int | None) -> DataFrame:
        batches = [n for n in self.folders("batch") if n > after and (before is None or n < before)] or [-1]
        reader = self.spark.read.schema(self.with_batch).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/batch={n}" for n in batches]).select(*self.with_batch.fieldNames())

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their batch (a merged row: its last one), or those of earlier batches."""
        last = max([n for n in self.folders("upto") if before is None or n < before], default=-2)
        rows = self.in_batches(last, before)
        return rows.unionByName(self.merged(last)) if last >= 0 else rows

    def of_batch(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch}")

    def last(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The rows of each key's last batch; a null in a key is a value like any other."""
        names = [*keys, "batch"]
        last = rows.groupBy(*keys).agg(F.max("batch").alias("batch")).toDF(*[f"last {k}" for k in names])
        return rows.join(last, reduce(and_, [F.col(k).eqNullSafe(F.col(f"last {k}")) for k in names]), "left_semi")

    def summed(self, keys: list[str], value: str, before: int | None = None) -> DataFrame:
        return self.read(before).groupBy(*keys).agg(F.sum(value).alias(value))

    def latest(self, keys: list[str]) -> DataFrame:
        """The rows that each key's last batch has: one row a key if it was an upsert, a group if it was a replacement."""
        return self.last(self.read(), keys).select(*self.schema.fieldNames())
