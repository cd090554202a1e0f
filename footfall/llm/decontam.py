"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Tokens are lower-cased runs of letters and digits. A mask selects some tokens of a run and ignores
the others; the selected tokens' hash at every place of every text joins the same hashes of the
benchmark items. A hit names a diagonal, the difference of the two places; there the texts are
aligned token by token, and the overlap counts if some window of `WINDOW` aligned tokens has at most
`ERRORS` substitutions. The two masks hit every such window (tests prove it), so the seeds miss
nothing that the check accepts.

An item shorter than the window must match whole. With `TOLERANT` tokens or more it may have as many
substitutions; then one of its first three runs of three tokens is intact, so these runs are its
seeds, by a third mask that ignores nothing and is searched only if there are such items. Items of
`least` tokens or more, but fewer than that, must match exactly; still shorter ones are no evidence
and aren't reported. `least` may be 1: items of one or two tokens are found by these tokens alone.

All masks begin with two selected tokens. Where the items have few different pairs there, other
places of a text are passed over before anything else is hashed.

Items of the same text are searched once and all reported; a null item_id is reported as null. Null
and empty texts on either side match nothing, rows with a null id are searched, and very long texts
and items are searched whole: the check takes time in proportion to the aligned tokens. Rows that
agree in id and text give one row for each item. An empty table on either side gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, named_as, plain

#: Selected offsets; the spans are 8 and 9 tokens, and 3 for short items.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORT_MASK, SHORT_PLACES = (0, 1, 2), (0, 3, 6)
WINDOW, ERRORS, TOLERANT, LEAST = 13, 2, 9, 5
SPAN = 1 + max(m[-1] for m in MASKS)
#: Benchmark seeds that may be broadcast (some 30 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Diagonals of one text and item that are compared at once.
DIAGONALS = 64
#: Different first pairs that are written into the plan (8 bytes each); with more, all places are hashed.
MOST_PAIRS = 50_000


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def once(value: Column) -> Column:
    """The value by way of a generator: what uses it in a lambda doesn't compute it again for each element."""
    return F.explode(F.array(value))


def coded(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and `coded`, the tokens' hashes, of the rows that have a text."""
    return df.filter(F.col(text).isNotNull()).select(*keep, once(F.transform(tokens(text), lambda w: F.xxhash64(w))).alias("coded"))


def items(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(item: tokens' hashes, ids, item_no): the different items."""
    own = coded(benchmark, "item_id").filter(F.size("coded") >= max(1, least))
    named = own.groupBy(F.col("coded").alias("item")).agg(F.collect_set(F.struct("item_id")).alias("ids"))
    return named.withColumn("item_no", F.xxhash64("item"))


def seed(n: int, at: Column) -> Column:
    """Mask n's hash of a run that begins with its first token."""
    mask = (*MASKS, SHORT_MASK)[n]
    return F.xxhash64(F.lit(n), *[F.get(at, F.lit(k)) for k in mask])


def sown(bench: DataFrame) -> DataFrame:
    """(item_no, own: place in the item, seed, pair: hash of the first two tokens there)."""
    size = F.size("item")

    def everywhere(n: int) -> Column:
        last = size - MASKS[n][-1] - 1
        return F.when(size >= WINDOW, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.lit(n).alias("n"), i.alias("own"))))

    each = [everywhere(n) for n in range(len(MASKS))]
    short = lambda *places: F.array(*[F.struct(F.lit(len(MASKS)).alias("n"), F.lit(p).alias("own")) for p in places])
    each.append(F.when(size < TOLERANT, short(0)).when(size < WINDOW, short(*SHORT_PLACES)))
    none = F.array().cast("array<struct<n:int,own:int>>")
    at = bench.select("item_no", "item", F.explode(F.concat(*[F.coalesce(x, none) for x in each])).alias("at"))
    at = at.select("item_no", "at.n", "at.own", F.slice("item", F.col("at.own") + 1, SPAN).alias("run"))
    hashed = F.when(F.col("n") == 0, seed(0, F.col("run"))).when(F.col("n") == 1, seed(1, F.col("run"))).otherwise(seed(2, F.col("run")))
    return at.select("item_no", "n", "own", hashed.alias("seed"), F.xxhash64(F.get("run", F.lit(0)), F.get("run", F.lit(1))).alias("pair")).distinct()


def seeds(texts: DataFrame, pairs: list[int] | None, masks: list[int]) -> DataFrame:
    """(row_no, place, seed) from (row_no, coded), at places whose first pair is one of `pairs`, if given."""
    shortest = min((*MASKS, SHORT_MASK)[n][-1] + 1 for n in masks)
    last = F.size("coded") - shortest
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    if pairs is not None:
        places = F.filter(places, lambda i: F.xxhash64(F.get("coded", i), F.get("coded", i + 1)).isin(pairs))
    runs = F.transform(places, lambda i: F.struct(i.alias("place"), F.slice("coded", i + 1, SPAN).alias("run")))
    at = texts.select("row_no", F.explode(runs).alias("at")).select("row_no", "at.place", "at.run")
    each = [F.when(F.size("run") > (*MASKS, SHORT_MASK)[n][-1], seed(n, F.col("run"))) for n in masks]
    return at.select("row_no", "place", F.explode(F.array(*each)).alias("seed")).filter("seed is not null")


def of_few_tokens(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, row_no, item_id, matched, aligned) for items of one or two tokens: the different tokens and pairs of each text, joined with them."""
    single = F.transform("coded", lambda a: F.array(a))
    pairs = F.zip_with("coded", F.slice("coded", 2, F.greatest(F.size("coded"), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.array(a, b)))
    runs = coded(rows, "doc_id", "row_no").dropDuplicates(["row_no"]).select("doc_id", "row_no", F.explode(F.array_distinct(F.concat(single, pairs))).alias("item"))
    met = runs.filter("item is not null").join(bench, "item").select("doc_id", "row_no", F.explode("ids").alias("id"), F.size("item").alias("n"))
    return met.select("doc_id", "row_no", "id.item_id", F.col("n").alias("matched"), F.col("n").alias("aligned"))


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row_no, item_id, matched, aligned) of each diagonal that counts; row_no is the hash of doc_id and text."""
    bench = durable(items(benchmark, least))
    few_tokens = len(SHORT_MASK)
    if least < few_tokens:
        small, bench = bench.filter(F.size("item") < few_tokens), bench.filter(F.size("item") >= few_tokens)
        rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_no"))
        return searched(docs, bench).unionByName(of_few_tokens(rows, small))
    return searched(docs, bench)


def searched(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The same for items of as many tokens as the shortest mask has, or more."""
    own = durable(sown(bench))
    hint = F.broadcast if own.count() <= MOST_BROADCAST else lambda x: x
    masks = sorted(r["n"] for r in own.select("n").distinct().collect()) or [0]
    firsts = own.select("pair").distinct().limit(MOST_PAIRS + 1)
    pairs = [r["pair"] for r in firsts.collect()]
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_no"))
    found = seeds(coded(rows, "row_no"), pairs if len(pairs) <= MOST_PAIRS else None, masks)
    met = found.join(hint(own.select("item_no", "own", "seed")), "seed")
    hits = met.select("row_no", "item_no", (F.col("place") - F.col("own")).alias("diagonal")).distinct()
    hits = durable(hits.groupBy("row_no", "item_no").agg(F.collect_set("diagonal").alias("diagonals")))

    some = hits.select("row_no").distinct()
    few = hits.count() <= MOST_BROADCAST
    texts = rows.join(F.broadcast(some) if few else some, "row_no", "left_semi").dropDuplicates(["row_no"])
    texts = coded(texts, "doc_id", "row_no").join(F.broadcast(hits) if few else hits, "row_no").join(hint(bench), "item_no")

    def equal(d: Column) -> Column:
        start = F.greatest(F.lit(0), -d)
        n = F.least(F.size("item"), F.size("coded") - d) - start
        return F.zip_with(F.slice("item", start + 1, n), F.slice("coded", start + d + 1, n), lambda a, b: (a == b).cast("int"))

    portions = F.transform(F.sequence(F.lit(0), F.floor((F.size("diagonals") - 1) / DIAGONALS).cast("int")), lambda i: F.slice("diagonals", i * DIAGONALS + 1, F.lit(DIAGONALS)))
    texts = texts.withColumn("diagonals", F.explode(portions))  # a repeated token has as many diagonals as both texts have places
    lines = texts.select("doc_id", "row_no", "ids", F.size("item").alias("size"), F.explode(F.transform("diagonals", equal)).alias("equal"))
    width = F.least(F.lit(WINDOW), F.col("size"))
    wrong = F.when(F.col("size") >= TOLERANT, ERRORS).otherwise(0)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    starts = F.sequence(F.lit(1), F.size("equal") - width + 1)
    counts = F.when(F.size("equal") >= width, F.exists(starts, lambda i: total(F.slice("equal", i, width)) >= width - wrong)).otherwise(False)
    lines = lines.filter(counts).select("doc_id", "row_no", total(F.col("equal")).alias("matched"), F.size("equal").alias("aligned"), F.explode("ids").alias("id"))
    return lines.select("doc_id", "row_no", "id.item_id", "matched", "aligned")


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, matched, aligned): most tokens matched on one diagonal, of those aligned there."""
    return matches(docs, benchmark, least).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("aligned").alias("aligned"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without the rows whose own text overlaps any item, whatever their ids."""
    bad = durable(matches(docs, benchmark, least).select(F.col("row_no").alias("bad row")).distinct())
    keyed = plain(docs, "doc_id", "text").withColumn("own row", F.xxhash64("doc_id", "text"))
    kept = keyed.join(F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad, F.col("own row") == F.col("bad row"), "left_anti")
    return named_as(kept, docs, "doc_id", "text")
