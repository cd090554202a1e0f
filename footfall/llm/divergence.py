"""Source divergence audit: how far each source's terms are from the other sources' and from its language's.

Tasks count terms with DuckDB over Arrow batches; Spark adds the counts up by language, source and term
and deals them to shards by a hash of language and term. A shard has all sources of its terms, so DuckDB
can tell there which terms are kept, and, once Spark has added up the kept counts, make each pair's share of
the sums and the best terms of its own. Spark merges shares and rankings.

Sums over all kept terms are made from the terms that both sources of a pair have. With p0 the p of a
term that a source lacks, na and nb the kept terms that a and b have,
  sum f(pa, pb) = sum over terms of both [f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)]
    + sum over a's terms f(pa, p0b) + sum over b's terms f(p0a, pb) + (V - na - nb) f(p0a, p0b);
the middle sums come from how many terms a source has at each p. So absent terms cost nothing.

A task holds one shard, of SHARD rows or so; a pair's shares are as many as shards have terms of both.
The result has a row for each pair of a language's sources, by contract.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

#: Runs of ASCII letters and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that a kept term is in, at least; ranks of terms; what counts are smoothed by, and the scale of p.
LEAST, TOP, MORE, SCALE = 10, 10, 2, 1_000_000_000
#: Counts of a shard, about; counts that a task gathers before it passes them on; bytes of text that are cut up at once.
SHARD, GATHERED, TEXT = 250_000, 500_000, 4_000_000
MEMORY = "400MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNT = f"""insert into counts select lang, source, term, sum(n), count(*) from (
  select row_no, lang, source, term, count(*) as n from (
    select row_no, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from part) group by all) group by all"""
ADDED_UP = "select lang, source, term, cast(sum(n) as bigint) as n, cast(sum(docs) as bigint) as docs from counts group by all"
KEPT = "select lang, source, term, n, row_number() over (partition by lang, term order by source) = 1 as first from rows qualify sum(docs) over (partition by lang, term) >= {least}"
F_OF = "((({0}) - ({1})) * (({0}) - ({1}))) // (({0}) + ({1}))"
SHARES = f"""with t as (select *, sum(n) over (partition by lang, term) as all_n from rows),
q as (select *, 1 + cast({SCALE} * cast(all_n + {MORE} as hugeint) // (lang_n + {MORE} * cast(v as hugeint)) as bigint) as q from t),
best as (select 'term' as part, lang, source, term as item, {F_OF.format("p", "q")} as value from q where n > 0 and p > q
  qualify row_number() over (partition by lang, source order by value desc, item) <= {{top}}),
pair as (select 'pair' as part, a.lang, a.source, b.source as item,
  cast(sum({F_OF.format("a.p", "b.p")} - {F_OF.format("a.p", "b.p0")} - {F_OF.format("a.p0", "b.p")} + {F_OF.format("a.p0", "b.p0")}) as bigint) as value
  from rows a join rows b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all)
select * from best union all select * from pair"""


class Duck:
    """A DuckDB connection of one task: one thread, bounded memory, what spills in a folder that goes with it."""

    def __enter__(self) -> duckdb.DuckDBPyConnection:
        self.folder = tempfile.mkdtemp(prefix="duck-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder, "preserve_insertion_order": False})
        return self.con

    def __exit__(self, *_) -> None:
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about so many bytes of text; a longer text is a slice of its own."""
    for b in batches:
        begin, held = 0, 0
        for i, size in enumerate(pc.binary_length(b.column(column)).to_pylist()):
            if i > begin and held + size > most:
                yield b.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < b.num_rows:
            yield b.slice(begin)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from rows (lang, source, text), a line or a few for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Duck() as con:
            con.execute("create table counts (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
            held = 0
            for b in pieces(batches, 2, TEXT):
                part = pa.Table.from_batches([b]).append_column("row_no", pa.array(range(b.num_rows)))
                con.register("part", part)
                held += con.execute(COUNT).fetchone()[0]
                con.unregister("part")
                if held > GATHERED:
                    con.execute(f"create or replace table counts as {ADDED_UP}")
                    held = con.execute("select count(*) from counts").fetchone()[0]
                    if held > GATHERED // 2:
                        yield from con.execute(ADDED_UP).to_arrow_table().to_batches(10_000)
                        con.execute("delete from counts")
                        held = 0
            yield from con.execute(ADDED_UP).to_arrow_table().to_batches(10_000)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def by_shard(rows: DataFrame, shards: int, sql: str, schema: str) -> DataFrame:
    """The SQL's rows over the `rows` of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Duck() as con:
            some = False
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                con.execute("insert into rows select * from batch" if some else "create table rows as select * from batch")
                con.unregister("batch")
                some = True
            if some:
                yield from con.execute(sql).to_arrow_table().to_batches(10_000)

    return rows.repartition(shards, "lang", "term").mapInArrow(run, schema)


def smoothed(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly."""
    exact = lambda c: c.cast("decimal(28,0)")
    scaled = (exact(n) + MORE) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, exact(total) + exact(kept) * F.lit(MORE)) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` to each other source of the language, `term` the terms that a source overuses.

    Null texts, languages and sources count as empty ones, so that nulls and '' are one group. A group
    without kept terms counts as one that uses all alike; where a language keeps no term its pairs have
    value 0. Every row of docs is a document, repeated ones too. Ties go to the smaller item; ids and other
    columns are not read. An empty table gives none, and a language's only source has no pairs.
    """
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = written(counted(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // SHARD))
    kept = written(by_shard(counts, shards, KEPT.format(least=least), "lang string, source string, term string, n long, first boolean"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("terms"))
    nothing = F.lit(0).cast("long")
    groups = named.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("group_n", "terms", "v", "lang_n")])
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, smoothed(nothing, F.col("group_n"), F.col("v")))))

    rows = kept.join(groups.drop("terms"), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "n", smoothed(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), "p0", "v", "lang_n")
    shares = written(by_shard(rows, shards, SHARES.format(top=top), "part string, lang string, source string, item string, value long"))

    levels = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))  # how many terms a source has at each p
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"))
    lone = levels.join(others, "lang").filter("source <> item")
    lone = lone.groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(F.sum(F.col("terms") * apart(F.col("p"), F.col("item_p0"))).alias("value"))
    both = shares.filter("part = 'pair'").select("lang", "source", "item", "value")
    parts = both.unionByName(lone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    second = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("p0").alias("item_p0"))
    pairs = groups.join(second, "lang").filter("source < item").join(parts, ["lang", "source", "item"], "left")
    absent = (F.col("v") - F.col("terms") - F.col("item_terms")) * apart(F.col("p0"), F.col("item_p0"))
    pairs = pairs.select("lang", "source", "item", (F.coalesce("value", nothing) + F.coalesce(absent, nothing)).alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    terms = ranked(shares.filter("part = 'term'")).filter(F.col("rank") <= top)
    out = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(terms)
    return out.select("lang", "source", "part", "item", "value", "rank")
