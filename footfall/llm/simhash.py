"""SimHash near-duplicates with pivot distance tables.

Every text gets a fingerprint of 64 bits a lane. The pivot table holds, for each distinct
fingerprint, its Hamming distances to fixed reference fingerprints. By the triangle inequality two
fingerprints within d bits differ by at most d in each of these coordinates, so a pair with a larger
difference in any coordinate is discarded before the exact distance is taken.

Keys that bring candidates together come from families of references, see `pivots`: the search loses
no link.

Fingerprints are the nodes; ids are labels only. Null and empty texts, and texts without words, have
fingerprint zero and are linked like any other. Rows with a null id or an id that repeats are
compared like any other; a component without any id has a null component_id. Rows that repeat stay,
one result row each. Very long texts are read whole. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable
from .nearcopies import drop_near_duplicates as drop_near_duplicates
from .pivots import CHUNK, Search, covering_masks, pivot_table
from .prints import fingerprint, shingle_hashes


def fingerprints(docs: DataFrame, shingle: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp0, ...): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprint(shingle_hashes(t, shingle), lanes) for t in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(lanes)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    names = [f"fp{k}" for k in range(lanes)]
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


def links(reps: DataFrame, names: list[str], distance: int, masks: list[list[int]], chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between the numbers `rep` of different fingerprints; their components are those of all pairs within the distance."""
    table = pivot_table(reps.select(F.col("rep").alias("node"), *names), len(names))
    finer = lambda mask, n: covering_masks(distance, n, fixed=mask)
    return Search(table, masks, distance, finer, chunk=chunk).links()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs.

    component_id is the smallest id reachable over links of at most `distance` differing bits.
    """
    prints = durable(fingerprints(docs, shingle, 1, id_col, text_col))
    nodes = durable(prints.groupBy(F.col("fp0").alias("node")).agg(F.min("doc_id").alias("least")))
    reps = nodes.select(F.col("node").alias("rep"), F.col("node").alias("fp0"))
    found = components(links(reps, ["fp0"], distance, covering_masks(distance, nodes.count())))
    known = nodes.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    labels = durable(known.groupBy("part").agg(F.min("least").alias("component_id")))
    named = durable(known.join(labels, "part").select(F.col("node").alias("fp0"), "component_id"))
    hexed = F.lpad(F.lower(F.hex("fp0")), 16, "0")
    return prints.join(named, "fp0", "left").select("doc_id", hexed.alias("fingerprint"), "component_id")
