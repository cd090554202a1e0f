"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of n-grams up to `order` (two, or more if asked),
unigrams and the uniform distribution. Its mixture weights depend on how often the longest context
was seen (one bucket for each power of two) and are learned by expectation-maximisation on held-out
counts: one seventh of the documents, set aside from the training counts while the weights are
learned and counted with them afterwards.

Documents are dealt to blocks of bounded size by a hash of id and text. Rows that agree in both and are
more than `REPEATS` get blocks of their own, whose n-grams are the same whichever of them they hold; so
these rows are spread at random. A block sends each n-gram that occurs in it once, in packed arrays by ranges of the n-grams' 64-bit
hashes, so sizes are even however frequent a word is. The exchange is a tree. While blocks and ranges
are up to `FAN`, it has one level: the task of a range adds up the blocks' counts and sends each block
the totals in the order it asked. Beyond `FAN` the senders are grouped and the ranges are divided level by
level: a task merges what a group of senders asks in a range, asks once for all of them, and relays
the answers on the way back. So the rows are at most `FAN` for each block and level, the levels grow
with the corpus' logarithm (one to about 100 GB of text, two to a thousand terabytes), and no task
holds more than about a block or a shard.

The held-out tokens' estimates are counted by eighths of powers of two, and each bucket's weights are
fitted in a task of its own, which holds at most the steps to the power of the order.

A null text is empty: it has the end token alone. Very long texts are read whole. Rows that repeat are
documents of their own, wherever they are dealt. Null ids count as the empty string for the folds. An
empty table gives no rows, and with no training document all counts are 0. Other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bucket_of, durable

END, START = 1, 2
#: Characters in a block and tokens in a shard, about; senders and subranges of a task of the exchange.
BLOCK, SHARD, FAN = 8_000_000, 1_000_000, 16_384
#: So many equal rows go to blocks of their own, and so many of them to each block; and the most keys of such rows that are broadcast.
REPEATS, MOST_BROADCAST = 1000, 200_000
#: Parts by hash in which the blocks of repeated rows are numbered.
PARTS = 1024
#: Folds of a block: training, training and held out for the weights, not learned from.
LEARN, WEIGH, OTHER = 0, 1, 2
CLASSES = 48  # of contexts' frequencies: powers of two
NEVER = -(1 << 14)  # a quantised probability of 0


def squeezed(a: np.ndarray) -> bytes:
    """An array of uint64, its bytes by plane, compressed; the length is in front."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def repeated(docs: DataFrame) -> DataFrame:
    """(copy_of, first, many): for rows that repeat often, their hash and which blocks are theirs."""
    often = docs.groupBy(F.xxhash64("doc_id", "text").alias("copy_of")).agg(F.ceil(F.count("*") / REPEATS).alias("many"))
    often = durable(often.filter("many > 1").withColumn("part", F.pmod("copy_of", F.lit(PARTS))))
    before = F.sum("sum").over(W.orderBy("part")) - F.col("sum")  # over PARTS rows at most
    begins = often.groupBy("part").agg(F.sum("many").alias("sum")).select("part", before.alias("before"))
    upto = F.sum("many").over(W.partitionBy("part").orderBy("copy_of"))
    numbered = often.withColumn("first", upto - F.col("many")).join(F.broadcast(begins), "part")
    return durable(numbered.select("copy_of", (F.col("before") + F.col("first")).alias("first"), "many"))


def dealt(docs: DataFrame, held_out: Column, tree: Exchange, often: DataFrame) -> DataFrame:
    """(block, ids, sizes, body): some documents of a block, their lower-cased texts compressed together."""
    fold = F.when(held_out, OTHER).when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(7)) == 0, WEIGH).otherwise(LEARN)
    copy = F.xxhash64("doc_id", "text")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), fold.alias("fold"), copy.alias("copy"))
    of_fold = lambda values: F.get(F.array(*map(F.lit, values)), F.col("fold"))
    place = F.pmod(F.col("copy"), of_fold(tree.own))
    if tree.theirs:
        picked = picked.join(F.broadcast(often) if tree.theirs <= MOST_BROADCAST else often, F.col("copy") == F.col("copy_of"), "left")
        place = F.when(F.col("copy_of").isNull(), place).otherwise(of_fold(tree.own) + F.col("first") + F.floor(F.rand(7) * F.col("many")))
    picked = picked.select("doc_id", "text", (of_fold(tree.begin) + place).cast("int").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, of = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_numpy()
            order = np.argsort(of, kind="stable")
            rows: list[tuple] = []
            for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                own = [texts[i].lower() for i in part]
                rows.append((int(of[part[0]]), [ids[i] for i in part], [len(t) for t in own], pa.compress(b"".join(own), codec="zstd", asbytes=True)))
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "ids", "sizes", "body"])

    return picked.mapInArrow(run, "block int, ids array<long>, sizes array<long>, body binary")


class Hashes(dict):
    """Words to their hashes."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = max(3, xxhash.xxh64_intdigest(word, 7))
        return h


def mixed(context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    h = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (tokens + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def read(table: pa.Table, order: int) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """Ids, where each document begins, and the hashes of the n-grams that end at each token, for n from 1."""
    ids, sequences, known = [], [], Hashes()
    for own, sizes, body in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "body")), strict=True):
        raw, at = pa.decompress(body, decompressed_size=sum(sizes), codec="zstd", asbytes=True), 0
        for i, size in zip(own, sizes, strict=True):
            words = raw[at : at + size].split()
            at += size
            ids.append(i)
            sequences.append(np.fromiter((known[w] for w in words), np.uint64, len(words)))
            sequences.append(np.array([END], np.uint64))
    lengths = np.array([len(s) for s in sequences]).reshape(-1, 2).sum(1)
    begin = np.cumsum(lengths) - lengths
    grams = [np.concatenate(sequences)]
    for _ in range(1, order):
        before = np.roll(grams[-1], 1)
        before[begin] = START
        grams.append(mixed(before, grams[0]))
    return ids, begin, grams


ROWS = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("to", pa.int64()), ("sender", pa.int64()), ("grams", pa.binary()), ("total", pa.binary()), ("held", pa.binary()), ("facts", pa.list_(pa.int64()))])
ASKED = "kind int, range long, to long, sender long, grams binary, total binary, held binary, facts array<long>"


def rows_of(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(ROWS)], schema=ROWS)


def counted(b: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, np.uint64) if b is None else unsqueezed(b)


class Exchange:
    """The tree's shape: `fan` subranges of a range and `group` senders of a task, over `levels` levels.

    Its senders are the folds' blocks: `own` of them by fold, from number `begin` on, and in each fold
    `theirs` more for rows that repeat often.
    """

    def __init__(self, own: list[int], theirs: int, shards: int, most: int):
        self.own, self.theirs, self.levels = own, theirs, 1
        self.begin = [sum(own[:k]) + k * theirs for k in range(len(own))]
        blocks = sum(own) + len(own) * theirs
        while most**self.levels < max(blocks, shards):
            self.levels += 1
        root = lambda n: next(k for k in range(max(1, int(n ** (1 / self.levels)) - 1), n + 2) if k**self.levels >= n)
        self.fan, self.group = root(shards), root(blocks)

    def fold(self, block: int) -> int:
        return sum(block >= b for b in self.begin[1:])

    def asks(self, kind: int, range_: int, level: int, sender: int, grams: np.ndarray, total: np.ndarray, held: np.ndarray) -> list[tuple]:
        """Rows of the next level for sorted grams of a range; steps between neighbours are sent."""
        parts = self.fan**level
        cuts = np.array([(range_ * self.fan + j) * 2**64 // parts for j in range(1, self.fan)], np.uint64)
        ends = [0, *np.searchsorted(grams, cuts).tolist(), len(grams)]
        squeeze = lambda x: squeezed(x) if x.any() else None
        return [
            (kind, range_ * self.fan + j, sender // self.group, sender, squeezed(np.diff(grams[a:b], prepend=np.uint64(0))), squeeze(total[a:b]), squeeze(held[a:b]), None)
            for j, (a, b) in enumerate(zip(ends, ends[1:], strict=False))
            if a < b
        ]

    def answer(self, kind: int, range_: int, level: int, sender: int, total: np.ndarray, held: np.ndarray) -> tuple:
        """For a sender of the level below; a block gets held-out counts only if it is one of those."""
        wanted = level > 1 or self.fold(sender) == WEIGH
        return (kind, range_, sender, None, None, squeezed(total), squeezed(held) if wanted else None, None)


def asked(tree: Exchange, order: int):
    """A block's n-grams and their counts in it."""

    def run(table: pa.Table) -> pa.Table:
        block, rows = table.column("block")[0].as_py(), []
        fold = tree.fold(block)
        for kind, grams in enumerate(read(table, order)[2]):
            each, n = np.unique(grams, return_counts=True)
            n, none = n.astype(np.uint64), np.zeros(len(n), np.uint64)
            rows += tree.asks(kind, 0, 1, block, each, n if fold != OTHER else none, n if fold == WEIGH else none)
        return rows_of(rows)

    return run


def merged(table: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Senders, where each one's n-grams are among all different ones, these, and their counts."""
    senders = table.column("sender").to_pylist()
    grams = [np.cumsum(unsqueezed(x), dtype=np.uint64) for x in table.column("grams").to_pylist()]
    each, place = np.unique(np.concatenate(grams), return_inverse=True)
    sums = []
    for c in ("total", "held"):
        own = [counted(x, len(g)) for x, g in zip(table.column(c).to_pylist(), grams, strict=True)]
        sums.append(np.bincount(place, np.concatenate(own).astype(float), len(each)).astype(np.uint64))
    return senders, np.split(place, np.cumsum([len(g) for g in grams])[:-1]), each, *sums


def key_of(table: pa.Table) -> tuple[int, int, int]:
    return tuple(table.column(c)[0].as_py() for c in ("kind", "range", "to"))


def passed_on(tree: Exchange, level: int):
    """What a group of senders asks of a range, asked once for all of them."""

    def run(table: pa.Table) -> pa.Table:
        kind, range_, to = key_of(table)
        _, _, each, total, held = merged(table)
        return rows_of(tree.asks(kind, range_, level, to, each, total, held))

    return run


def answered(tree: Exchange):
    """For each sender the corpus counts of its n-grams (total, and held out for the weights).

    One row more, to -1, has facts: tokens, different tokens; then those without the held-out ones.
    """

    def run(table: pa.Table) -> pa.Table:
        kind, range_, _ = key_of(table)
        senders, places, _, total, held = merged(table)
        rows = [tree.answer(kind, range_, tree.levels, s, total[p], held[p]) for s, p in zip(senders, places, strict=True)]
        if not kind:
            rows.append((kind, range_, -1, None, None, None, None, [int(x) for t in (total, total - held) for x in (t.sum(), (t > 0).sum())]))
        return rows_of(rows)

    return run


def relayed(tree: Exchange, level: int):
    """The answers for a group of senders, each one's own picked out."""

    def run(asks: pa.Table, answers: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return rows_of([])
        kind, range_, _ = key_of(asks)
        senders, places, each, _, _ = merged(asks)
        answers = answers.sort_by("child")
        total, held = (np.concatenate([unsqueezed(x) for x in answers.column(c).to_pylist()]) for c in ("total", "held"))
        assert len(total) == len(each), "the answers don't fit what was asked"
        return rows_of([tree.answer(kind, range_, level, s, total[p], held[p]) for s, p in zip(senders, places, strict=True)])

    return run


def looked_up(texts: pa.Table, answers: pa.Table, order: int, column: str) -> tuple[list, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Ids, where documents begin, the counts of the n-grams at each token, and those of their contexts."""
    ids, begin, grams = read(texts, order)
    answers = answers.sort_by([("kind", "ascending"), ("range", "ascending")])
    kinds, packed = answers.column("kind").to_pylist(), answers.column(column).to_pylist()
    found = []
    for kind, own in enumerate(grams):
        each, place = np.unique(own, return_inverse=True)
        total = np.concatenate([unsqueezed(x) for x, k in zip(packed, kinds, strict=True) if k == kind])
        assert len(each) == len(total), "a block's answers don't fit its n-grams"
        found.append(total[place].astype(float))
    contexts = []
    for counts in found[:-1]:
        context = np.roll(counts, 1)
        context[begin] = found[0][np.append(begin[1:], len(found[0])) - 1]  # a start is as frequent as the end
        contexts.append(context)
    return ids, begin, found, contexts


def estimates(counts: list[np.ndarray], contexts: list[np.ndarray], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The longest context's class, and the estimates from the longest n-grams to unigrams."""
    kind = np.minimum(CLASSES - 1, np.ceil(np.log2(contexts[-1] + 1))).astype(np.int64)
    return kind, [two / np.maximum(1, context) for two, context in zip(counts[:0:-1], contexts[::-1], strict=True)] + [counts[0] / max(1, n)]


def quantised(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(8 * np.log2(np.where(p > 0, p, 1))), NEVER).astype(np.int64)


def held_names(order: int) -> list[str]:
    return ["kind", *[f"q{k}" for k in range(order, 0, -1)], "n"]


def held_out_counts(order: int, n: int):
    """How many held-out tokens have a context of some class and such estimates, in eighths of powers of two."""
    names = held_names(order)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        total, held = (looked_up(texts, answers, order, c)[2:] for c in ("total", "held"))
        kind, p = estimates(*([x - y for x, y in zip(a, b, strict=True)] for a, b in zip(total, held, strict=True)), n)
        rows, count = np.unique(np.stack([kind, *map(quantised, p)]), axis=1, return_counts=True)
        return pa.table(dict(zip(names, [*rows, count], strict=True)))

    return run


def mixture_of(rows: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """One class' mixture weights by expectation-maximisation; rows: class, quantised estimates, count."""
    own = rows[:, 1:-1]
    p = np.concatenate([np.where(own > NEVER, 2.0 ** (np.maximum(own, -8000) / 8), 0), np.full((len(own), 1), 1 / (v + 1))], 1)
    n = rows[:, -1:].astype(float)
    w = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = p * w
        w = (share / share.sum(1, keepdims=True) * n).sum(0) / n.sum()
    return np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()


def for_all_classes(known: dict[int, np.ndarray], order: int) -> np.ndarray:
    """CLASSES x (order + 1); a class without held-out tokens takes the weights of the nearest one below, and else even ones."""
    out = np.full((CLASSES, order + 1), 1 / (order + 1))
    for kind in range(CLASSES):
        out[kind] = known[kind] if kind in known else out[max(0, kind - 1)]
    return out


def weights(rows: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """The mixture weights of all classes; rows: class, quantised estimates, count."""
    return for_all_classes({int(k): mixture_of(rows[rows[:, 0] == k], v, rounds) for k in np.unique(rows[:, 0])}, rows.shape[1] - 2)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored(order: int, n: int, v: int, mixture: np.ndarray):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({c: pa.array([], pa.float64() if "score" in c else pa.int64()) for c in ("doc_id", "n_tokens", "n_known", "base_score", "score")})
        ids, begin, counts, contexts = looked_up(texts, answers, order, "total")
        kind, p = estimates(counts, contexts, n)
        w, one = mixture[kind], counts[0]
        p = np.log10(sum(w[:, k] * x for k, x in enumerate(p)) + w[:, -1] / (v + 1))
        base = np.log10((one + 1) / (n + v + 1))
        size = np.diff(np.append(begin, len(one)))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": size, "n_known": np.add.reduceat((one > 0).astype(np.int64), begin), "base_score": np.add.reduceat(base, begin), "score": np.add.reduceat(p, begin)})

    return run


def scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, block: int = BLOCK, shard: int = SHARD, fan: int = FAN, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    held_out = bucket_of("doc_id", modulus) == remainder
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shares = [(1 - 1 / modulus) * 6 / 7, (1 - 1 / modulus) / 7, 1 / modulus]
    often = repeated(docs)
    theirs = often.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    tree = Exchange([math.ceil((size + 1) * s / block) for s in shares], theirs, math.ceil((size + 1) / 6 / shard), fan)
    texts = dealt(docs, held_out, tree, often)
    asks = [texts.groupBy("block").applyInArrow(asked(tree, order), ASKED)]
    for level in range(2, tree.levels + 1):
        asks[-1] = durable(asks[-1])
        asks.append(asks[-1].groupBy("kind", "range", "to").applyInArrow(passed_on(tree, level), ASKED))
    answers = durable(asks[-1].groupBy("kind", "range").applyInArrow(answered(tree), ASKED))
    facts = answers.filter("to = -1").agg(*[F.coalesce(F.sum(F.get("facts", F.lit(i))), F.lit(0)) for i in range(4)]).first()
    n, v, n_rest, v_rest = facts
    answers = answers.filter("to >= 0")
    for level in range(tree.levels - 1, 0, -1):
        found = answers.withColumn("child", F.col("range")).withColumn("range", F.floor(F.col("range") / tree.fan)).groupBy("kind", "range", "to")
        answers = durable(asks[level - 1].groupBy("kind", "range", "to").cogroup(found).applyInArrow(relayed(tree, level), ASKED))
    answers = answers.select(F.col("to").cast("int").alias("block"), "kind", "range", "total", "held")

    weigh = lambda df: df.filter(F.col("block").between(tree.begin[WEIGH], tree.begin[OTHER] - 1)).groupBy("block")
    names = held_names(order)
    held = weigh(texts).cogroup(weigh(answers)).applyInArrow(held_out_counts(order, n_rest), ", ".join(f"{c} long" for c in names))
    held = held.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": [int(pdf["kind"].iloc[0])], "w": [mixture_of(pdf[names].sort_values(names).to_numpy(), v_rest)]})

    found = held.groupBy("kind").applyInPandas(fit, "kind long, w array<double>").collect()  # CLASSES rows at most
    mixture = for_all_classes({r["kind"]: np.array(r["w"]) for r in found}, order)

    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored(order, n, v, mixture), SCORES)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
