"""Exact search for the highest inner products, by an index of pivot distances.

Pivots are means of a bounded sample, and every row x is keyed by its nearest pivot p and its distance from
it: the rows of one pivot within a range of distances are an annulus. An annulus knows its least and greatest
distance and its longest row. By the triangle inequality none of its rows is nearer to a query q than
gap = max(low - d(q, p), d(q, p) - high), so as 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 no inner product is above
(|q|^2 + longest^2 - gap^2) / 2; nor is it above q.p + |q| high, or |q| longest. The least of these is its bound.

Annuli, in order, are cut into blocks of some 4,096 rows: small neighbours share one, large ones are dealt
to many by row, so copies of one vector make no large task. Queries first probe the few best annuli, which
gives each a score that its results must reach; probes widen, and the last search takes every annulus whose bound
reaches that score. It is complete by itself, so no result depends on the pivots, the sample or rounding.

The driver holds the sample, pivots and one line for each annulus, all bounded by parameters; requests, rows and scores
are shuffled, by block. Where vectors have no structure (random directions in many dimensions) bounds
exclude little, and the search is one of all queries against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written
from .vectors import dot, matrix, scaled, sliced, whole

#: Rows that pivots and ranges of distance are learned from; every row is indexed.
SAMPLE = 20_000
#: Pivots at most, and annuli of each.
PIVOTS, RINGS = 1024, 16
#: Rows of a block and queries that meet it at once.
BLOCK, CHUNK = 4096, 1024
#: Annuli that queries probe before the last search.
PROBES = (4, 32)
HITS = "query_no long, score long, id {kind}, row_no long"


@dataclass
class Annuli:
    """Pivots, the ranges' edges, and each annulus' distances, longest row, first block and number of blocks."""

    pivots: np.ndarray
    edges: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    longest: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def distances(self, y: np.ndarray) -> np.ndarray:
        squares = (y * y).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * (y @ self.pivots.T)
        return np.sqrt(np.maximum(0, squares))

    def keyed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's annulus, its distance from its pivot, and its length."""
        y = x.astype(np.float64)
        d = self.distances(y)
        near = d.argmin(1)
        apart = d[np.arange(len(x)), near]
        ring = (apart[:, None] > self.edges[near]).sum(1)
        return near * (self.edges.shape[1] + 1) + ring, apart, np.sqrt((y * y).sum(1))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Queries by annuli: no inner product with a row of the annulus is above."""
        y, rings = q.astype(np.float64), self.edges.shape[1] + 1
        long = np.sqrt((y * y).sum(1))[:, None]
        d, by_pivot = np.repeat(self.distances(y), rings, axis=1), np.repeat(y @ self.pivots.T, rings, axis=1)
        reach = long + self.longest + self.high
        gap = np.maximum(0, np.maximum(self.low - d, d - self.high) - 1e-6 * reach)  # more than rounding can take from a distance
        least = np.minimum((long**2 + self.longest**2 - gap**2) / 2, np.minimum(by_pivot + long * self.high, long * self.longest))
        return least + 1e-9 * reach**2 + 1


def fitted(rows: DataFrame, width: int, count: int, sample: int, pivots: int, rings: int, seed: int) -> Annuli:
    """Pivots by a few rounds of means over the sample, and ranges that split its distances evenly."""
    drawn = F.pmod(F.xxhash64("row_no", F.lit(seed)), F.lit(2**40)) < 2**40 * 9 // 10 * sample // max(1, count)
    share = rows.select("x") if count <= sample else rows.filter(drawn).select("x")
    got = share.limit(sample).toArrow()["x"]
    index = Annuli(np.zeros((1, width)), np.zeros((1, 0)))
    y = matrix(got, width).astype(np.float64)
    if not len(y):
        return index
    k, rng = max(1, min(pivots, int(count**0.5) // 4, len(y))), np.random.default_rng(seed)
    index.pivots = y[rng.choice(len(y), k, replace=False)]
    for _ in range(5):
        near = index.distances(y).argmin(1)
        for p in np.unique(near):
            index.pivots[p] = np.rint(y[near == p].mean(0))
    d = index.distances(y)
    near, apart = d.argmin(1), d.min(1)
    steps = np.linspace(0, 1, rings + 1)[1:-1]
    even = np.quantile(apart, steps)
    index.edges = np.array([np.quantile(apart[near == p], steps) if (near == p).any() else even for p in range(k)])
    return index


def asked(queries: DataFrame, index: Annuli, least: int | None) -> DataFrame:
    """(block, query_no, x, reach): the blocks of the annuli that may reach a query's score, of the `least` best ones if given."""
    shared = queries.sparkSession.sparkContext.broadcast(index)
    width = index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        some = np.flatnonzero(known.blocks)
        for b in sliced(batches, 256):
            reach = np.array([-np.inf if r is None else r for r in b.column(2).to_pylist()], np.float64)
            bound = known.bounds(matrix(b.column(1), width))[:, some]
            wanted = bound >= reach[:, None]
            if least is not None and len(some) > least:
                best = np.argpartition(-bound, least - 1, axis=1)[:, :least]
                near = np.zeros_like(wanted)
                np.put_along_axis(near, best, True, axis=1)
                wanted &= near
            row, annulus = np.nonzero(wanted)
            annulus = some[annulus]
            n = known.blocks[annulus]
            row, start = np.repeat(row, n), np.repeat(known.first[annulus], n)
            block = start + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique(np.column_stack([row, block]), axis=0)
            for k in range(0, len(pairs), 4096):
                take = pa.array(pairs[k : k + 4096, 0])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + 4096, 1]), *[c.take(take) for c in b.columns]], ["block", "query_no", "x", "reach"])

    return queries.select("query_no", "x", "reach").mapInArrow(run, "block long, query_no long, x array<bigint>, reach double")


def scored(requests: DataFrame, rows: DataFrame, width: int, k: int) -> DataFrame:
    """Each query's k best rows of each of its blocks, of those that reach its score; ties go to the smaller id, nulls last."""
    per_block = requests.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    asking = requests.withColumn("chunk", F.lit(0))
    many = per_block.filter("chunks > 1")
    rows = rows.select("block", "x", "id", "row_no")
    if not many.isEmpty():
        chunks = F.coalesce("chunks", F.lit(1)).cast("int")
        asking = requests.join(many, "block", "left").withColumn("chunk", F.pmod(F.xxhash64("query_no"), chunks).cast("int")).drop("chunks")
        rows = rows.join(many, "block", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    else:
        rows = rows.withColumn("chunk", F.lit(0))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["query_no", "score", "id", "row_no"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        right = right.sort_by([("id", "ascending"), ("row_no", "ascending")])  # nulls come last
        if left.num_rows and right.num_rows:
            x = matrix(right["x"], width)
            picks, numbers, scores = [], [], []
            for s in range(0, left.num_rows, 256):
                part = left.slice(s, 256)
                score = dot(matrix(part["x"], width), x)
                reach = [-np.inf if r is None else r for r in part["reach"].to_pylist()]
                last = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] > k else [-np.inf] * len(score)
                for no, line, low, bar in zip(part["query_no"].to_pylist(), score, reach, last, strict=True):
                    some = np.flatnonzero(line >= max(low, bar))
                    some = some[np.argsort(-line[some], kind="stable")][:k]
                    picks += some.tolist()
                    numbers += [no] * len(some)
                    scores += [max(-(2**63), min(2**63 - 1, int(v))) for v in line[some]]
            best = right.take(pa.array(picks, pa.int64()))
            out = [numbers, scores, best["id"], best["row_no"]]
        types = [pa.int64(), pa.int64(), right.schema.field("id").type, pa.int64()]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    keys = ["block", "chunk"]
    return asking.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, HITS.format(kind=kind))


def best(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_no").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_no")
    return hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def search(df: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, sample: int = SAMPLE, pivots: int = PIVOTS, rings: int = RINGS, probes: tuple[int, ...] = PROBES, seed: int = 1) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k rows with the highest inner products for each row that `queries` selects.

    Components count as floor(1024 * x); rows without a whole vector take no part. Every row but the
    query's own is a candidate: another row with the same id or the same vector is one. Ties go to the
    smaller id, nulls last. A query row that repeats is answered each time; fewer than k rows give fewer
    ranks; an empty table or no query gives none. Shorter vectors count as ending in zeros. Scores beyond
    a long are ranked among each block's by their true value, and returned and merged as the nearest long. Other columns
    than the two named are not read, but by `queries`.
    """
    rows = whole(df, vector).select(F.col(f"`{id_col}`").alias("id"), scaled(vector).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.withColumn("row_no", F.monotonically_increasing_id()))
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    index = fitted(rows, width, count, sample, pivots, rings, seed)
    rows = indexed(rows, index)
    own = rows.filter("asks")
    wanted = written(own.groupBy("x").agg(F.min("row_no").alias("query_no")))  # equal queries are searched for once
    now = wanted.withColumn("reach", F.lit(None).cast("double"))
    for least in (*probes, None):
        hits = scored(asked(now, index, least), rows, width, k + 1)
        found = written(best(hits, k + 1))
        if least is not None:
            score = F.col("score").cast("double")
            reach = F.when(F.abs(score) < 2**52, score).otherwise(score - F.abs(score) * 1e-12)  # a double may be above the long
            now = wanted.join(found.filter(F.col("place") == k + 1).select("query_no", reach.alias("reach")), "query_no", "left")
    asking = own.join(wanted, "x").select("query_no", F.col("id").alias("query_id"), F.col("row_no").alias("own_no"))
    answers = found.select("query_no", F.col("row_no").alias("found_no"), F.col("id").alias("found"), "score")
    each = asking.join(answers, "query_no").filter("own_no <> found_no")
    order = W.partitionBy("own_no").orderBy(F.desc("score"), F.asc_nulls_last("found"), "found_no")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found").alias(id_col), "score")


def indexed(rows: DataFrame, index: Annuli) -> DataFrame:
    """Every row with its block, as a table; the index learns how far each annulus reaches and which blocks it has."""
    shared, width = rows.sparkSession.sparkContext.broadcast(index), index.pivots.shape[1]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            annulus, apart, long = shared.value.keyed(matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(annulus, pa.int32()), pa.array(apart), pa.array(long)], [*b.schema.names, "annulus", "apart", "long"])

    kind = rows.schema["id"].dataType.simpleString()
    keyed = written(rows.mapInArrow(key, f"id {kind}, x array<bigint>, asks boolean, row_no long, annulus int, apart double, long double"))
    n = len(index.pivots) * (index.edges.shape[1] + 1)
    index.low, index.high, index.longest, size = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for a, *distances, held in keyed.groupBy("annulus").agg(F.min("apart"), F.max("apart"), F.max("long"), F.count("*")).collect():  # a line an annulus
        (index.low[a], index.high[a], index.longest[a]), size[a] = distances, held
    most = max(64, min(BLOCK, 2**22 // max(1, width)))
    index.first, index.blocks, block, held = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
    for a in np.flatnonzero(size):
        if held and held + size[a] > most:
            block, held = block + 1, 0
        parts = -(-size[a] // most)
        index.first[a], index.blocks[a] = block, parts
        block, held = (block, held + size[a]) if parts == 1 else (block + parts, 0)
    spread = rows.sparkSession.createDataFrame([(int(a), int(index.first[a]), int(index.blocks[a])) for a in np.flatnonzero(size)], "annulus int, first long, parts long")
    block = F.col("first") + F.pmod(F.xxhash64("row_no"), F.col("parts"))
    return keyed.join(F.broadcast(spread), "annulus").select("id", "x", "asks", "row_no", block.alias("block"))
