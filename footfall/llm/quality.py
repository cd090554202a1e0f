"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed cutoffs say the same for all languages and sources. Here each rule's cutoff comes from the
distribution of its metric in the document's own language and source: an upper fence
`Q3 + K * max(Q3 - Q1, spread)`, and a lower one for the length of words. The quantiles are read off
a sketch with fixed relative error: integer metrics fall into buckets that keep their five leading
bits (values under 32 are exact), and a sketch is the count of each bucket. Sketches merge by adding
counts, in any order and with the same result: those of a language's sources give the language's,
which judges documents whose own group has fewer than `LEAST` rows, and all together judge small
languages. `spread` is the least width, without which a group of equal documents would reject the
first one that differs.

A null text has no words, and very long texts are read whole. Null languages and sources are groups like any other. Rows that repeat are
judged alike and count as often as they occur; null ids stay. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, durable

SPAN = 5
#: Metric: least width of the spread, lower fence too.
RULES = {"symbol_rate": (40, False), "dup_line_rate": (100, False), "word_length": (80, True)}
K, LEAST = 3, 100
#: Groups whose thresholds may be broadcast (some 100 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 200_000
CONTRACT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def base(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        *keep,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    own = F.sequence(F.lit(0), F.size("words") - SPAN)
    grams = F.when(F.size("words") > SPAN, F.transform(own, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SPAN)])))
    read = read.select(
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        grams.alias("grams"),
    )
    # most texts repeat no window: only the others' windows are sorted
    read = read.withColumn("grams", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.col("grams")))
    read = read.withColumn("grams", F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def beside(i: Column, step: int) -> Column:
        return F.coalesce(F.get("grams", i + step)["h"] == F.get("grams", i)["h"], F.lit(False))

    twice = F.filter("grams", lambda g, i: beside(i, -1) | beside(i, 1))
    read = read.withColumn("places", F.array_sort(F.transform(twice, lambda g: g["i"]))).drop("grams")
    steps = F.transform("places", lambda p, i: F.least(F.lit(SPAN), F.coalesce(F.get("places", i + 1) - p, F.lit(SPAN))))
    total = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return read.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("places")


def rates(df: DataFrame) -> DataFrame:
    """The rules' metrics, in thousandths or hundredths; null where they have no sense."""
    return df.withColumns({
        "symbol_rate": F.expr("case when word_chars > 0 then n_symbols * 1000 div word_chars end"),
        "dup_line_rate": F.expr("case when n_lines > 0 then n_dup_lines * 1000 div n_lines end"),
        "word_length": F.expr("case when n_words > 0 then word_chars * 100 div n_words end"),
    })


def bucket(v: Column) -> Column:
    """The least value with the same five leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketch(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rule, value, n): one mergeable sketch for each group and rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("value")) for r in RULES])).alias("m")
    each = df.select(*groups, pairs).filter("m.value is not null")
    return each.groupBy(*groups, "m.rule", "m.value").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "rule", "value").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, size, and for each rule its low and high), one row for each group."""
    over = W.partitionBy(*groups, "rule")
    ranked = sketches.withColumn("upto", F.sum("n").over(over.orderBy("value"))).withColumn("all", F.sum("n").over(over))
    quart = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("value")))
    found = ranked.groupBy(*groups, "rule").agg(quart(1).alias("q1"), quart(3).alias("q3"), F.max("all").alias("size"))
    spread = reduce(lambda c, r: c.when(F.col("rule") == r, RULES[r][0]), RULES, F.when(F.lit(False), 0))
    wide = K * F.greatest(F.col("q3") - F.col("q1"), spread)
    found = found.withColumns({"high": F.col("q3") + wide, "low": F.col("q1") - wide})
    cols = [F.max(F.when(F.col("rule") == r, F.col(side))).alias(f"{r}_{side}") for r in RULES for side in ("low", "high")]
    return found.groupBy(*groups).agg(F.max("size").alias("size"), *cols)


def judged(docs: DataFrame) -> DataFrame:
    """For every row of docs the counts, base_failed, kept, lang, source, the rates and the thresholds' `level`."""
    counts = rates(base(docs, ["doc_id", "lang", "source"]))
    counts = durable(counts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    own = durable(sketch(counts, ["lang", "source"]))
    by_lang, by_all = merged(own, ["lang"]), merged(own, [])
    left = counts
    for name, found, groups in (("source", fences(own, ["lang", "source"]), ["lang", "source"]), ("lang", fences(by_lang, ["lang"]), ["lang"])):
        found = found.select(F.struct(*[c for c in found.columns if c not in groups]).alias(f"by_{name}"), *[F.col(g).alias(f"{g}_of") for g in groups])
        on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_of")) for g in groups])
        found = durable(found)  # a row a group: broadcast while there are few, and else a group with many documents can be split
        left = left.join(F.broadcast(found) if found.count() <= MOST_BROADCAST else found, on, "left").drop(*[f"{g}_of" for g in groups])
    overall = fences(by_all, []).first()  # one row of a few numbers
    left = left.withColumn("by_all", F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in overall.asDict().items()]))
    enough = lambda n: F.col(f"by_{n}.size") >= LEAST
    left = left.withColumn("level", F.when(enough("source"), "source").when(enough("lang"), "lang").otherwise("all"))
    left = left.withColumn("t", F.when(enough("source"), F.col("by_source")).when(enough("lang"), F.col("by_lang")).otherwise(F.col("by_all")))
    good = F.lit(True)
    for r, (_, lower) in RULES.items():
        good = good & F.coalesce(F.col(r) <= F.col(f"t.{r}_high"), F.lit(True))
        if lower:
            good = good & F.coalesce(F.col(r) >= F.col(f"t.{r}_low"), F.lit(True))
    left = left.withColumn("kept", ~F.col("base_failed") & good)
    return left.select(*CONTRACT, *[c for c in left.columns if c not in (*CONTRACT, "by_source", "by_lang", "by_all", "t")])
