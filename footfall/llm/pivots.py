"""Pairs of fingerprints within a Hamming distance, by pivot distance tables.

The table alone gives no join key: a difference of a few bits is no equality. Keys are families of
references that differ from each other only inside a chosen set of bits. Two fingerprints have the
same distances to a whole family exactly if they agree on those bits, so what is joined are the
masked bits. For a small distance the families cover all pairs within it (`covering_masks`): no link
is lost. For a large one they are random bit sets, as many as the wanted recall asks for
(`sampled_masks`), and the limit of the pivot test may be set below the distance, where it discards
most unrelated pairs and few related ones.

A bucket of up to `SMALL` fingerprints is joined with itself. In a larger one all members are first
compared with its first one; members that are joined by then need no comparison with each other, so
only the rest is dealt in chunks, compared among themselves and with the others. Each pair of chunks
is one bounded task, and a dense group of any size costs a number of comparisons in proportion to it.
What large buckets have joined isn't compared again in small ones.

A bucket in which so many are left that each would go to more chunks than there are finer masks is
crowded. It is split by finer masks over the bits that its own mask leaves free, made by the same rule
for its size, so its rows grow with the number of these masks and not with the square of the bucket.
Small and large finer buckets are treated as above.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable
from .prints import MASK64

SMALL, CHUNK = 64, 512
#: References of a pivot table; eight coordinates share a long.
PIVOTS = 32
#: Keys of large buckets that may be broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: The most bits of a sampled mask: with them 365 masks reach the recall at similarity 0.8 (from 3 * 10^8 texts on); beyond, buckets grow
#: (some 60 unrelated ones at 10^9 texts, 600 at 10^10), and finer masks split those that are crowded.
WIDEST = 24


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def free_bits(bits: int, fixed: list[int]) -> list[int]:
    """Places of the bits that a mask of some lanes leaves free."""
    return [i for i in range(bits) if not (fixed and fixed[i // 64] >> (i % 64) & 1)]


def covering_masks(distance: int, n: int, bits: int = 64, fixed: list[int] | None = None) -> list[list[int]]:
    """Masks such that any two fingerprints within `distance` bits agree on at least one of them.

    The number of blocks grows with n, the number of distinct fingerprints, so that a bucket holds a
    few unrelated ones however large the input is; there are at most C(2d + 2, d) masks. For n
    fingerprints that agree on the mask `fixed` they cover the other bits.
    """
    free = free_bits(bits, fixed or [])
    blocks = distance + 2
    while n / 2 ** (len(free) * (blocks - distance) / blocks) > 4 and blocks < 2 * distance + 2:
        blocks += 1
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [[sum(part[i] for i in keep)] for keep in combinations(range(blocks), blocks - distance)]


def bits_for(similarity: float) -> float:
    """The share of bits in which fingerprints of two sets of even size and that Jaccard similarity differ, on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distance_for(similarity: float, lanes: int, deviations: float = 2.3) -> int:
    """So many bits that some 99 of 100 pairs of that similarity differ in no more."""
    total, share = 64 * lanes, bits_for(similarity)
    return math.ceil(total * share + deviations * math.sqrt(total * share * (1 - share)))


@cache
def masks_needed(similarity: float, width: int, total: int, recall: float) -> int:
    """How many random masks of that width over `total` bits give pairs of just that similarity the recall."""
    share = bits_for(similarity)
    odds = [math.exp(math.lgamma(total + 1) - math.lgamma(d + 1) - math.lgamma(total - d + 1) + d * math.log(share) + (total - d) * math.log(1 - share)) for d in range(total - width)]
    agree = [math.prod((total - d - i) / (total - i) for i in range(width)) for d in range(total - width)]
    count = 1
    while sum(p * (1 - a) ** count for p, a in zip(odds, agree, strict=True)) > 1 - recall:
        count += 1
    return count


def sampled_masks(similarity: float, n: int, lanes: int, recall: float = 0.97, seed: int = 7, fixed: list[int] | None = None) -> list[list[int]]:
    """Random sets of bits, so large that a bucket holds some 16 to 32 unrelated ones.

    As many as give pairs of just that similarity the recall, over the distribution of the bits in
    which they differ. At similarity 0.8 they are 24 at 50,000 texts, 124 at 10^7, 235 at 10^8, and
    365 from 3 * 10^8 on. For n fingerprints that agree on the mask `fixed` they are of the other bits.
    """
    width = min(WIDEST, max(10, math.ceil(math.log2(max(2, n))) - 5))
    free = free_bits(64 * lanes, fixed or [])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(masks_needed(similarity, width, len(free), recall)):
        picked = sum(1 << free[i] for i in rng.choice(len(free), width, replace=False))
        out.append([picked >> (64 * k) & MASK64 for k in range(lanes)])
    return out


def references(lanes: int, many: int, seed: int = 11) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    return [[int(x) for x in rng.integers(0, 2**64, lanes, dtype=np.uint64)] for _ in range(many)]


def bits_apart(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a.bitwiseXOR(b)) for a, b in pairs]).cast("long")


def pivot_table(prints: DataFrame, lanes: int, many: int = PIVOTS) -> DataFrame:
    """Adds the distances to the references, eight to a long (p0, p1, ...).

    A coordinate keeps 0 to 127, from 64 below the middle on; what is cut there differs no more than before.
    """
    least = max(0, 32 * lanes - 64)
    away = [bits_apart([(F.col(f"fp{k}"), F.lit(signed(x))) for k, x in enumerate(p)]) for p in references(lanes, many)]
    away = [F.least(F.greatest(x - least, F.lit(0)), F.lit(127)) for x in away]
    packed = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(away[8 * k + i], 8 * i) for i in range(8)]) for k in range(many // 8)]
    return prints.select("*", *[x.alias(f"p{k}") for k, x in enumerate(packed)])


class Search:
    """Pairs of table's rows (node, fp0, ..., p0, ..., and size, if sizes count) within `distance` bits.

    `limit` is that of the pivot test; `alike` is the least ratio of two rows' sizes, if given.
    `finer` gives the masks that split a crowded bucket of a mask and a number of rows.
    """

    def __init__(
        self, table: DataFrame, masks: list[list[int]], distance: int, finer: Callable[[list[int], int], list[list[int]]], limit: int | None = None, alike: float = 0.0, chunk: int = CHUNK
    ):
        self.table, self.masks, self.distance, self.finer, self.alike, self.chunk = table, masks, distance, finer, alike, chunk
        self.limit = distance if limit is None else limit
        self.lanes = [c for c in table.columns if c.startswith("fp")]
        self.pivots = [c for c in table.columns if c.startswith("p") and c[1:].isdigit()]
        self.family = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(signed(m))) for c, m in zip(self.lanes, mask, strict=True)]) for t, mask in enumerate(masks)]
        self.keyed = table.select("*", F.posexplode(F.array(*self.family)).alias("family", "key"))
        counted = self.keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"))
        self.large = durable(counted.filter(F.col("n") > SMALL))

    def discarded(self, x: str, y: str) -> Column:
        """Whether any coordinate differs by more than the limit."""
        tests = []
        for c in self.pivots:
            for i in range(8):
                one, two = (F.shiftright(F.col(f"{s}.{c}"), 8 * i).bitwiseAND(255) for s in (x, y))
                tests.append(F.abs(one - two) > self.limit)
        return reduce(lambda a, b: a | b, tests)

    def near(self, x: str, y: str) -> Column:
        apart = bits_apart([(F.col(f"{x}.{c}"), F.col(f"{y}.{c}")) for c in self.lanes])
        near = ~self.discarded(x, y) & (apart <= self.distance)
        if self.alike:
            one, two = F.col(f"{x}.size"), F.col(f"{y}.size")
            near = (F.least(one, two) >= self.alike * F.greatest(one, two) - 1e-9) & near
        return near

    def links(self) -> DataFrame:
        """(a, b): edges whose components are those of all pairs; they may repeat."""
        if self.large.isEmpty():
            return self.pairs(self.keyed.withColumn("part", F.col("node")), self.large)
        stars = lambda parts: parts.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = components(durable(self.led()))
        parts = components(durable(stars(parts).union(self.apart(parts))))
        known = self.table.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        return stars(parts).union(self.pairs(known.withColumn("key", F.explode(F.array(*self.family))), self.large))

    def pairs(self, keyed: DataFrame, large: DataFrame) -> DataFrame:
        """(a, b), a > b: pairs of buckets that aren't large, of different parts; they may repeat."""
        few = keyed.join(hinted(large.select("key")), "key", "left_anti")
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.part") != F.col("y.part"))
        return few.alias("x").join(few.alias("y"), met & self.near("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def led(self) -> DataFrame:
        """(a, b): members of large buckets near the first one there."""
        first = self.large.select("key", F.col("first").alias("node")).join(self.table, "node")
        members = self.keyed.join(hinted(self.large.select("key")), "key", "left_semi")
        both = members.alias("x").join(first.alias("y"), F.col("x.key") == F.col("y.key"))
        return both.filter((F.col("x.node") != F.col("y.node")) & self.near("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()

    def apart(self, parts: DataFrame) -> DataFrame:
        """(a, b): pairs of large buckets that join, by any chain of them, what no component of parts (node, component) joins yet."""
        known = self.table.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        keys = self.keyed.select("key", "family", "node").join(hinted(self.large.select("key")), "key", "left_semi")
        members = durable(keys.join(known, "node").withColumn("weight", F.lit(1)))
        shares = durable(shares_of(members))
        masks, crowded = self.crowded(shares)
        if crowded is None:
            return self.dealt(members, shares).distinct()
        rest = self.dealt(members, shares.join(hinted(crowded), "key", "left_anti"))
        fine = self.split(members.join(hinted(crowded), "key", "left_semi"), masks)
        large = durable(fine.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL))
        found = rest.union(self.pairs(fine, large))
        if not large.isEmpty():
            of_large = fine.join(hinted(large.select("key")), "key", "left_semi")
            found = found.union(self.dealt(of_large, durable(shares_of(of_large))))
        return found.distinct()

    def crowded(self, shares: DataFrame) -> tuple[list[list[list[int]]], DataFrame | None]:
        """(finer masks of each mask, keys whose members would go to more chunks than there are finer masks, if any)."""
        most = shares.filter(F.col("others") > self.chunk).agg(F.max(F.col("mains") + F.col("others"))).first()[0]
        if most is None:
            return [], None
        masks = [self.finer(mask, most) for mask in self.masks]
        keys = durable(shares.filter(F.col("others") > self.chunk * max(map(len, masks))).select("key"))
        return masks, None if keys.isEmpty() else keys

    def split(self, members: DataFrame, masks: list[list[list[int]]]) -> DataFrame:
        """Members by the keys of the finer masks of their families; the table of masks is as large as the number of masks is."""
        cells = [(f, i, *map(signed, mask)) for f, each in enumerate(masks) for i, mask in enumerate(each)]
        own = [f"mask of {c}" for c in self.lanes]
        table = members.sparkSession.createDataFrame(cells, "family int, finer int, " + ", ".join(f"`{c}` long" for c in own))
        key = F.xxhash64("key", "finer", *[F.col(c).bitwiseAND(F.col(m)) for c, m in zip(self.lanes, own, strict=True)])
        return members.join(F.broadcast(table), "family").withColumn("key", key).select(*members.columns)

    def dealt(self, members: DataFrame, shares: DataFrame) -> DataFrame:
        """(a, b): pairs of members (key, node, part, weight, ...) of one key, dealt by pairs of chunks."""
        cols = ["key", "lo", "hi", "node", "part", *self.lanes, *self.pivots, *(["size"] if self.alike else [])]
        run = compared(self.distance, self.limit, self.alike, self.lanes, self.pivots)
        # dealt by the pair of chunks: left to itself, Spark keeps a key's pairs together, where the join has put them
        return deal(members, self.chunk, shares).select(*cols).repartition("key", "lo", "hi").groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def hinted(keys: DataFrame) -> DataFrame:
    """Keys to be broadcast if they are few enough; they are counted, so they should be cut from their lineage."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def shares_of(members: DataFrame) -> DataFrame:
    """(key, main, mains, others) of members (key, part, weight): the part of most weight, its weight, and the others'; keys of one part go."""
    count = members.groupBy("key", "part").agg(F.sum("weight").alias("n"))
    count = count.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("mains"), (F.sum("n") - F.max("n")).alias("others"))
    return count.filter("others > 0")


def deal(members: DataFrame, most: int, shares: DataFrame) -> DataFrame:
    """members (key, node, part, weight, ...) by pairs of chunks (key, lo, hi), so that members of a key in different parts meet.

    A chunk has a weight of about `most`. Members of a key's main part, the one of most weight, don't
    meet each other; the others meet everyone. A key that `shares` hasn't got is not dealt at all.
    """
    chunks = lambda n: F.ceil(F.col(n) / most).cast("int")
    met = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    upto = lambda n: F.sequence(F.lit(0), chunks(n) - 1)
    dealt = members.join(shares, "key").withColumn("own", F.col("part") == F.col("main"))
    place = F.pmod(F.xxhash64("node", F.lit(5)), F.when(F.col("own"), chunks("mains")).otherwise(chunks("others"))).cast("int")
    dealt = dealt.withColumn("place", place)
    beside = F.transform(upto("others"), lambda j: met(F.least(j, F.col("place")), F.greatest(j, F.col("place"))))
    across = F.transform(upto("mains"), lambda j: met(F.col("place"), -1 - j))
    from_main = F.transform(upto("others"), lambda i: met(i, -1 - F.col("place")))
    dealt = dealt.withColumn("task", F.explode(F.when(F.col("own"), from_main).otherwise(F.concat(beside, across))))
    return dealt.select(*members.columns, "task.lo", "task.hi")


def joined(part: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that join all parts which any chain of near pairs joins.

    near(front, free) gives near pairs of some rows in front with some free ones, at least one for each
    free row that has any.
    """
    members: dict[int, list[int]] = {}
    for i, p in enumerate(part.tolist()):
        members.setdefault(p, []).append(i)
    free, found = np.ones(len(part), bool), []
    for first in range(len(part)):
        if not free[first]:
            continue
        front = np.array(members[part[first]])
        free[front] = False
        while len(front) and free.any():
            reached: dict[int, tuple[int, int]] = {}
            for some in np.array_split(front, len(front) // 256 + 1):
                for a, b in zip(*(x.tolist() for x in near(some, np.flatnonzero(free))), strict=True):
                    reached.setdefault(part[b], (a, b))
                for p in reached:
                    free[members[p]] = False
                if not free.any():
                    break
            found += reached.values()
            front = np.array([i for p in reached for i in members[p]], int)
    pairs = np.array(found, int).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def compared(distance: int, limit: int, alike: float, lanes: list[str], pivots: list[str]):
    """For one pair of chunks: pairs within the distance that join different parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        bits = [pdf[c].to_numpy().view(np.uint64) for c in lanes]
        table = np.stack([pdf[c].to_numpy() for c in pivots], 1).view(np.uint8).reshape(len(pdf), -1).astype(np.int16)
        size = pdf["size"].to_numpy() if alike else None

        def near(front: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            i, j = np.nonzero(sum(np.bitwise_count(x[front][:, None] ^ x[free][None, :]).astype(np.int16) for x in bits) <= distance)
            i, j = front[i], free[j]
            if alike:
                ok = np.minimum(size[i], size[j]) >= alike * np.maximum(size[i], size[j]) - 1e-9
                i, j = i[ok], j[ok]
            ok = np.ones(len(i), bool)
            for k in range(0, len(i), 65536):
                some = slice(k, k + 65536)
                ok[some] = np.abs(table[i[some]] - table[j[some]]).max(1) <= limit
            return i[ok], j[ok]

        node = pdf["node"].to_numpy()
        i, j = joined(pdf["part"].to_numpy(), near)
        return pd.DataFrame({"a": np.maximum(node[i], node[j]), "b": np.minimum(node[i], node[j])})

    return run
