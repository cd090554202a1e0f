"""URL filtering against dated lists.

A list entry says what holds for a pattern from some time on: `block`, `allow` or `remove`. Entries
become intervals, each up to the pattern's next entry (`remove` only ends the one before; of entries
with the same pattern and time `block` wins over `allow` over `remove`). A pattern is a host, which
covers its subdomains, or a host with the first segments of a path. Every capture is joined with the
intervals of its own patterns that contain its time; the longest pattern decides.

Verdicts depend on URL and time only, so equal captures are judged once. A capture with a null or
malformed URL, without a time or without an active entry is allowed, with a null pattern. An empty
list allows all, and no captures give no rows. Rows that repeat stay; the captures' columns stay,
whatever their names, but `verdict` and `pattern`, which are replaced. Of a very long path only as
many segments are looked up as the longest pattern has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, plain

RANK = {"remove": 0, "allow": 1, "block": 2}


def normal(pattern: Column) -> Column:
    """Lower-case host, without `.` and `/` at the end; the path keeps its case."""
    host, path = F.regexp_extract(pattern, r"^([^/]*)(.*)$", 1), F.regexp_extract(pattern, r"^([^/]*)(.*)$", 2)
    return F.concat(F.regexp_replace(F.lower(host), r"\.+$", ""), F.regexp_replace(path, "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, since, until) from entries (pattern, action, at); until is null for the last ones."""
    known = entries.filter(F.col("action").isin(*RANK) & F.col("at").isNotNull() & F.col("pattern").isNotNull())
    rank = F.expr("case action " + " ".join(f"when '{k}' then {v}" for k, v in RANK.items()) + " end")
    one = known.groupBy(normal(F.col("pattern")).alias("pattern"), F.col("at").cast("timestamp").alias("since")).agg(F.max_by("action", rank).alias("verdict"))
    one = one.withColumn("until", F.lead("since").over(W.partitionBy("pattern").orderBy("since")))
    return one.filter("verdict <> 'remove'")


def patterns(url: Column, depth: int) -> Column:
    """The patterns that cover a URL: its host, the host's parents, and the host with each start of the path, up to `depth` segments."""
    parts = r"^(?i:[a-z][a-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d*)?(/[^?#]*)?(?:[?#].*)?$"
    host = F.split(F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r"\.+$", ""), r"\.")
    steps = F.filter(F.split(F.regexp_extract(url, parts, 2), "/"), lambda s: s != "")
    parents = F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), "."))
    below = F.transform(F.slice(steps, 1, depth), lambda _, i: F.concat_ws("/", F.array_join(host, "."), F.slice(steps, F.lit(1), i + 1)))
    return F.when(url.rlike(parts), F.concat(parents, below))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """captures with `verdict` and the deciding `pattern` at the end."""
    listed = durable(intervals(entries))  # written out, so that a pattern that many captures have can be split in the join
    depth = listed.agg(F.max(F.regexp_count("pattern", F.lit("/")))).first()[0] or 0
    renamed = plain(captures)
    of = dict(zip(captures.columns, renamed.columns, strict=True))
    url, time = F.col(of[url_col]), F.col(of[time_col]).cast("timestamp")
    keys = renamed.select(url.alias("url"), time.alias("time")).distinct()
    asked = keys.select("url", "time", F.explode(patterns(F.col("url"), depth)).alias("pattern"))
    active = (F.col("time") >= F.col("since")) & (F.col("until").isNull() | (F.col("time") < F.col("until")))
    met = asked.join(listed, "pattern").filter(active)
    longest = F.max_by(F.struct("verdict", "pattern"), F.struct(F.length("pattern"), "pattern"))
    best = met.groupBy("url", "time").agg(longest.alias("best"))
    same = url.eqNullSafe(F.col("url")) & time.eqNullSafe(F.col("time"))
    own = [F.col(of[c]).alias(c) for c in captures.columns if c not in ("verdict", "pattern")]
    return renamed.join(best, same, "left").select(*own, F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.col("best.pattern").alias("pattern"))
