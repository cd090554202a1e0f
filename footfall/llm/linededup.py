"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is a window; windows are compared by two hashes over all
documents. A window's first occurrence is the one with the smallest (doc_id, hash of the text,
position), nulls first. Every later occurrence covers its three lines, except lines of the first
occurrence itself where the two overlap in one document; covered positions are merged and removed.

Windows of blank lines only (ASCII white space) don't count. A text of fewer than three lines, an
empty one and a null stay as they are; very long texts are read whole. An empty table gives no rows. Rows that agree in doc_id and text are one document: they are changed alike. Other
columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, durable, plain

LINES = 3


def rows_with_keys(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row key", F.xxhash64(F.col("text"), F.col("doc_id"), F.lit(3)))


def windows(keyed: DataFrame) -> DataFrame:
    """(at: doc_id, row key, position; h, g: the window's hashes)."""
    lines = keyed.select("doc_id", "row key", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= LINES)

    def hashed(i: Column) -> Column:
        own = [F.get("lines", i + k) for k in range(LINES)]
        blank = ~F.concat(*own).rlike(WORD)
        return F.when(~blank, F.struct(F.xxhash64(*own).alias("h"), F.hash(*own).alias("g")))

    each = lines.select("doc_id", "row key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), hashed)).alias("pos", "w"))
    return each.filter("w is not null").select(F.struct("doc_id", "row key", "pos").alias("at"), "w.h", "w.g")


def covered(keyed: DataFrame) -> DataFrame:
    """(doc_id, row key, gone: positions to remove) for the documents that lose lines."""
    found = windows(keyed)
    first = found.groupBy("h", "g").agg(F.min("at").alias("first"), F.min("at.pos").alias("low"), F.max("at").alias("last")).filter("first <> last")
    # written out, so that a window that very many documents share can be split where it meets its occurrences
    first = durable(first.select(F.col("h").alias("h1"), F.col("g").alias("g1"), "first"))
    later = found.join(first, (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1"))).filter("at <> first")
    same = F.col("at.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at.`row key`") == F.col("first.`row key`"))
    start = F.when(same, F.greatest(F.col("at.pos"), F.col("first.pos") + LINES)).otherwise(F.col("at.pos"))
    spans = later.select("at.doc_id", "at.row key", F.sequence(start, F.col("at.pos") + LINES - 1).alias("span"))
    return spans.groupBy("doc_id", "row key").agg(F.array_distinct(F.flatten(F.collect_set("span"))).alias("gone"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the texts less their repeated windows, and `lines removed` at the end, for a column of that name."""
    docs = docs.drop("lines removed")
    keyed = rows_with_keys(plain(docs, "doc_id", "text"))
    gone = covered(keyed).select(F.col("doc_id").alias("id of"), F.col("row key").alias("key of"), F.col("gone").alias("lines gone"))
    both = keyed.join(gone, keyed["doc_id"].eqNullSafe(F.col("id of")) & (F.col("row key") == F.col("key of")), "left")
    both = both.withColumn("all lines", F.when(F.col("lines gone").isNotNull(), F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("all lines") - 1), F.col("lines gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("all lines", i)), "\n")
    text = F.when(F.col("lines gone").isNull(), F.col("text")).otherwise(kept)
    rest = [text.alias(c) if c == "text" else F.col(c if c == "doc_id" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return both.select(*rest, F.coalesce(F.size("lines gone"), F.lit(0)).alias("lines removed"))
