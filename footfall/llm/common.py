"""What several corpus operators share: durable cuts of the lineage, components, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: So many edges (16 bytes each) are one task's in `components`; more are joined in rounds.
TASK_EDGES = 100_000


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the cluster's shared folder; a temporary one is made only for a local session that names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder; losing executors can't lose them."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder.

    A checkpoint keeps the estimate of its plan's size, which every join multiplies: in a loop of joins
    it soon has more digits than can be computed. A table's size is that of its files.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the place that driver and executors share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(df: DataFrame, *same: str) -> DataFrame:
    """df with its columns named c0, c1, ... in order but for `same`, so that none clashes with what an operator adds."""
    return df.toDF(*[c if c in same else f"c{i}" for i, c in enumerate(df.columns)])


def named_as(df: DataFrame, like: DataFrame, *same: str) -> DataFrame:
    """The columns that plain(like, *same) has, under the names they had."""
    return df.select(*[F.col(c if c in same else f"c{i}").alias(c) for i, c in enumerate(like.columns)])


def bucket_of(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null counts as the empty string."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is a grouped minimum and a join on the
    node, and the number of rounds is logarithmic in the length of the longest chain. Edges that
    repeat, loops and an empty input are fine.

    Up to `TASK_EDGES` different edges no rounds are made, whose shuffles would start tasks without end
    for hardly any rows: one task joins them.
    """
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    if now.count() <= TASK_EDGES:
        return written(now.coalesce(1).mapInArrow(joined, "node long, component long"))
    before = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        # written out, so that the join's other side is dealt for the join alone and Spark can split a star's centre
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        upward = now.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a is always the greater one
        large = upward.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.union(root.select("a", F.col("m").alias("b"))).distinct())
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return written(stars.union(stars.select("component", "component").distinct()))


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) in batches; a tree's root is its smallest node."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_pydict({"node": pa.array(list(up), pa.int64()), "component": pa.array(map(root, list(up)), pa.int64())})
