"""One document of each group of near copies, by SimHash candidates and exact verification.

Two texts are linked if the Jaccard similarity of their sets of word shingles reaches the threshold.
Candidates come from SimHash fingerprints (four lanes, over the set) and the pivot search of
`pivots`: keys of masked bits, then the test of the largest coordinate difference, then the Hamming
distance. Components of these pairs are groups of candidates, and within a group every link is found
and verified on the whole sets, by an index of the group's shingles; no pair under the threshold is
linked. The search is random: a pair of just the threshold comes into one group with at least the
recall of `sampled_masks`, more similar ones more surely, and also by way of others.

Groups of a moderate number of shingles are packed together, many to a task. A larger one is dealt in
chunks: links are searched within each chunk, then among one member of each component of these, and
last between what is still apart. Members that are joined by then need no comparison, so a dense
group of any size takes work in proportion to it, and a task holds two chunks at most.

Texts of the same set are one node. Null and empty texts, and texts without words, have the empty
set and are copies of each other. Shingles and sets are 64-bit hashes; ids are labels only: rows
that share an id, or have none, are told apart by their texts, and rows that agree in both are one.
Very long texts are read whole. Other columns stay, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, named_as, plain
from .pivots import MOST_BROADCAST, Search, deal, distance_for, joined, pivot_table, sampled_masks, shares_of
from .prints import fingerprint, shingle_hashes

#: Lanes of the fingerprints, references of their pivot tables, and the limit of the pivot test: it
#: is below the distance, discards about two thirds of unrelated pairs and some 2 in 100 at the threshold.
LANES, REFERENCES, LIMIT = 4, 16, 20
#: Shingles in a chunk of sets, about; 8 bytes each. A longer text is a chunk of its own.
CHUNK = 500_000


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def shingle_set(text: bytes | None, shingle: int) -> tuple[int, np.ndarray]:
    """(key of the set, its shingles in ascending order)."""
    import xxhash

    own = np.unique(shingle_hashes(text, shingle))
    return (int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0), own


def sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, shingles): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, shingle) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([own.view(np.int64) for _, own in found], pa.list_(pa.int64()))], ["key", "shingles"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, shingles array<long>")


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(row_no, doc_id, node, size, fp0, ...): one row for each row of docs; node is the key of its set."""
    names = [f"fp{k}" for k in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, shingle) for t in b.column(2).cast(pa.binary()).to_pylist()]
            lanes = [fingerprint(own, LANES) for _, own in found]
            cols = [pa.array([k for k, _ in found], pa.int64()), pa.array([len(own) for _, own in found], pa.int32())]
            cols += [pa.array([x[k] for x in lanes], pa.int64()) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["row_no", "doc_id", "node", "size", *names])

    picked = docs.select(row_key().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "row_no long, doc_id long, node long, size int, " + ", ".join(f"{c} long" for c in names))


def sets_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of some nodes; one row of each is read again."""
    first = durable(rows.groupBy("node").agg(F.min("row_no").alias("wanted row")).join(nodes.select("node"), "node", "left_semi").select("wanted row"))
    some = docs.select("text", row_key().alias("row_no"))
    some = some.join(F.broadcast(first) if first.count() <= MOST_BROADCAST else first, F.col("row_no") == F.col("wanted row"), "left_semi")
    return sets(some, shingle).withColumnRenamed("key", "node").dropDuplicates(["node"])


def similar(similarity: float):
    """For the sets of one task: pairs that are so similar and join different parts, by an index of the shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        node, own = pdf["node"].to_numpy(), pdf["shingles"].tolist()
        size = np.array([len(s) for s in own])
        owner = np.repeat(np.arange(len(own)), size)
        _, code = np.unique(np.concatenate(own), return_inverse=True)
        ends = np.cumsum(np.bincount(code))
        holders = owner[np.argsort(code, kind="stable")]
        codes = np.split(code, np.cumsum(size)[:-1])

        def near(front: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            one, two = [], []
            for i in front.tolist():
                mine = codes[i]
                begin = np.where(mine > 0, ends[mine - 1], 0)
                many = ends[mine] - begin
                mine = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
                shared = np.bincount(holders[mine], minlength=len(own))[free]
                ok = free[shared >= similarity * (size[i] + size[free] - shared) - 1e-9]
                one.append(np.full(len(ok), i))
                two.append(ok)
            return np.concatenate(one), np.concatenate(two)

        i, j = joined(pdf["part"].to_numpy(), near)
        return pd.DataFrame({"a": np.maximum(node[i], node[j]), "b": np.minimum(node[i], node[j])})

    return run


def linked(members: DataFrame, similarity: float, *task: str) -> DataFrame:
    """Edges (a, b) among the members (node, part, shingles) of each task."""
    return members.select(*task, "node", "part", "shingles").repartition(*task).groupBy(*task).applyInPandas(similar(similarity), "a long, b long")


def search(nodes: DataFrame, n: int, similarity: float, recall: float) -> Search:
    """The candidates' search over nodes (node, size, fp0, ...), of which there are n."""
    table = pivot_table(nodes, LANES, REFERENCES)
    masks = lambda n, seen, fixed=None: sampled_masks(similarity, n, LANES, seen, fixed=fixed)
    finer = lambda mask, many: masks(many, 1 - (1 - recall) / 6, mask)
    return Search(table, masks(n, recall), distance_for(similarity, LANES), finer, LIMIT, similarity)


def near_sets(rows: DataFrame, docs: DataFrame, shingle: int, similarity: float, recall: float, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between keys of sets that are so similar; their components are those of all links in groups."""
    nodes = durable(rows.drop("row_no", "doc_id").dropDuplicates(["node"]))
    groups = components(search(nodes, nodes.count(), similarity, recall).links())
    groups = durable(groups.join(nodes.select("node", F.col("size").cast("long").alias("weight")), "node").filter("weight > 0"))
    known = durable(sets_of(groups, rows, docs, shingle))
    totals = durable(groups.groupBy("component").agg(F.sum("weight").alias("total")))
    small = totals.filter(F.col("total") <= chunk)
    bins = 1 + (small.agg(F.sum("total")).first()[0] or 0) // chunk
    number = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("total") / chunk))
    dealt = groups.join(totals, "component").select(
        "node",
        F.when(F.col("total") > chunk, F.col("component")).alias("key"),
        F.when(F.col("total") > chunk, number).otherwise(F.pmod(F.xxhash64("component", F.lit(3)), F.lit(bins))).alias("bin"),
    )
    edges = durable(linked(dealt.join(known, "node").withColumn("part", F.col("node")), similarity, "key", "bin"))
    large = totals.filter(F.col("total") > chunk).select("component")
    if large.isEmpty():
        return edges

    def members(parts: DataFrame) -> DataFrame:
        of_large = groups.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "component").withColumnRenamed("component", "key")
        return of_large.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    first = members(components(edges)).groupBy("key", "part").agg(F.min("node").alias("node"), F.min_by("weight", "node").alias("weight"))
    first = durable(first)
    bins = durable(first.groupBy("key").agg(F.ceil(F.sum("weight") / chunk).alias("bins")))
    first = first.join(bins, "key").withColumn("bin", F.pmod(F.xxhash64("node", F.lit(3)), F.col("bins")))
    edges = durable(edges.union(linked(first.join(known, "node"), similarity, "key", "bin")))
    apart = durable(members(components(edges)))
    dealt = deal(apart, chunk, durable(shares_of(apart)))
    return edges.union(linked(dealt.join(known, "node"), similarity, "key", "lo", "hi"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.97, chunk: int = CHUNK) -> DataFrame:
    """docs with one row of each group: that of the smallest id, then of the smallest hash of id and text.

    Groups are the components of links between texts whose sets of word shingles have at least the
    given Jaccard similarity. Rows without an id are compared as well and come after those with one.
    """
    rows = durable(prints(docs, shingle))
    found = components(near_sets(rows, docs, shingle, similarity, recall, chunk))
    firsts = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")).alias("first"))
    groups = firsts.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    kept = durable(groups.groupBy("part").agg(F.min("first").alias("kept")).select("kept.row_no"))
    gone = durable(rows.select("row_no").distinct().join(kept, "row_no", "left_anti").withColumnRenamed("row_no", "gone row"))
    twice = rows.groupBy("row_no").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("row_no").alias("twice row"))
    twice = durable(twice.join(kept, F.col("twice row") == F.col("row_no"), "left_semi"))

    small = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST else df
    keyed = plain(docs, "doc_id", "text").withColumn("row key", row_key()).join(small(gone), F.col("row key") == F.col("gone row"), "left_anti")
    if not twice.isEmpty():
        again = F.col("row key") == F.col("twice row")
        keyed = keyed.join(small(twice), again, "left_anti").union(keyed.join(small(twice), again, "left_semi").dropDuplicates(["row key"]))
    return named_as(keyed, docs, "doc_id", "text")
