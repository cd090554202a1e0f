"""Web-log lines to fields: parameters, user agent, region of the IP address, row key.

A line is `ip^Atime^Ahost^A/path?parameters`, where `^A` is a caret and an A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from footfall import functions as X
from footfall.sources.sinks import Batches, put_rows

#: What the events' short names stand for.
EVENTS = {"e_l": "launch event", "e_pv": "page view event", "e_crt": "charge request event", "e_cs": "charge success event", "e_cr": "charge refund event", "e_e": "event duration event"}
#: Browsers by a pattern whose group is the version; the first that is found counts.
BROWSERS = {"Edge": r"Edge?/([\d.]+)", "Opera": r"(?:OPR|Opera)[/ ]([\d.]+)", "Chrome": r"Chrome/([\d.]+)", "Firefox": r"Firefox/([\d.]+)", "IE": r"(?:MSIE |Trident/.*rv:)([\d.]+)", "Safari": r"Version/([\d.]+).*Safari/"}
#: Operating systems: family and the pattern of the name.
SYSTEMS = {"iOS": r"(iPhone OS [\d_]+|CPU OS [\d_]+)", "Windows": r"(Windows(?: NT)? [\d.]+|Windows)", "OS X": r"(Mac OS X(?: [\d_.]+)?)", "Android": r"(Android(?: [\d.]+)?)", "Linux": r"(Linux)"}
MOST_BROADCAST, SALTS = 200_000, 16
#: Buckets of the store by row key.
BUCKETS = 64
UNKNOWN = "unknown"


def decoded(text: Column) -> Column:
    """URL-decoded; null if a `%` has no two hex digits after it.

    Texts with nothing to decode, and those that can't be, don't reach the decoder: its exceptions
    cost far more than the rest of a line.
    """
    broken = text.rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(~text.rlike("[%+]"), text).when(~broken, F.try_url_decode(text))


def parameters(query: Column) -> Column:
    """`k=v&...` as a map: values decoded, blank or undecodable ones left out, of equal keys the last."""
    pair = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("value"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.contains("=")), pair)
    pairs = F.filter(pairs, lambda p: (p["key"] != "") & (F.trim(p["value"]) != ""))
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    last = lambda all_: F.filter(all_, lambda p, i: ~p["key"].eqNullSafe(F.get(all_, i + 1)["key"]))
    return F.map_from_entries(F.transform(X.let(placed, last), lambda p: F.struct(p["key"], p["value"])))


def whole(parts: Column) -> Column:
    """Whether a line's parts are four, the last one with a `?`."""
    return F.coalesce((F.size(parts) == 4) & F.get(parts, F.lit(3)).contains("?"), F.lit(False))


def readable(line: Column | str) -> Column:
    """Whether the line has four parts, the last one with a `?`."""
    return whole(F.split(X.col(line), r"\^A"))


def fields(line: Column | str) -> Column:
    """The line's parameters with `ip` and `s_time` (milliseconds), which win over parameters of these names.

    Null unless the line has four parts, the last one with a `?`.
    """
    return X.let(F.split(X.col(line), r"\^A"), lambda parts: F.when(whole(parts), fields_of(parts)))


def fields_of(parts: Column) -> Column:
    """The fields of a readable line's four parts."""
    at = lambda i: F.trim(F.get(parts, F.lit(i)))
    query = F.substring(at(3), F.instr(at(3), "?") + 1, F.length(at(3)))
    own = F.map_filter(parameters(query), lambda k, v: ~k.isin("ip", "s_time"))
    known = F.create_map(F.lit("ip"), at(0), F.lit("s_time"), X.server_millis(at(1)).cast("string"))
    return F.map_concat(own, known)


def user_agent(ua: Column | str) -> Column:
    """(browser, browser_v, os, os_v); null for a blank text, its fields null where nothing is known."""
    ua = X.col(ua)
    browser, version, system, name = (F.lit(None).cast("string") for _ in range(4))
    for k, pattern in reversed(BROWSERS.items()):
        browser, version = (F.when(ua.rlike(pattern), v).otherwise(old) for v, old in ((F.lit(k), browser), (F.regexp_extract(ua, pattern, 1), version)))
    for k, pattern in reversed(SYSTEMS.items()):
        system, name = (F.when(ua.rlike(pattern), v).otherwise(old) for v, old in ((F.lit(k), system), (F.regexp_extract(ua, pattern, 1), name)))
    made = F.struct(browser.alias("browser"), version.alias("browser_v"), system.alias("os"), name.alias("os_v"))
    return F.when(~X.is_empty(F.trim(ua)), made)


def ip_number(ip: Column | str) -> Column:
    """A dotted address as a number; null if it is none."""
    octets = F.transform(F.split(X.col(ip), r"\."), lambda x: x.try_cast("int"))
    good = (F.size(octets) == 4) & F.forall(octets, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    return F.when(good, F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def ip_text(number: Column | str) -> Column:
    n = X.col(number)
    return F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def located(df: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """df with `region`, that of the range (start_ip, end_ip, region: numbers, both ends in) that holds the address.

    Ranges don't overlap. They are cut at multiples of 65,536, so the range join becomes an equality
    on the upper half and a comparison; the pieces are at most the ranges and 65,536 more. They are
    broadcast while they are few. Beyond that both sides are salted, the pieces once for each salt, so
    that neither a busy network nor the rows without an address meet in one task.
    """
    pieces = ranges.select(F.explode(F.sequence(F.shiftright("start_ip", 16), F.shiftright("end_ip", 16))).alias("upper"), "start_ip", "end_ip", "region")
    few = pieces.count() <= MOST_BROADCAST
    salts = 1 if few else SALTS
    pieces = F.broadcast(pieces.withColumn("salt", F.lit(0))) if few else pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = df.withColumn("ip number", ip_number(ip)).withColumn("ip upper", F.shiftright("ip number", 16))
    keyed = keyed.withColumn("ip salt", F.lit(0) if few else F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    met = (F.col("ip upper") == F.col("upper")) & (F.col("ip salt") == F.col("salt")) & F.col("ip number").between(F.col("start_ip"), F.col("end_ip"))
    return keyed.join(pieces, met, "left").select(*[F.col(f"`{c}`") for c in df.columns if c != "region"], "region")


def region_parts(region: Column | str) -> Column:
    """(country, province, city) of a Chinese region name; what can't be told is `unknown`."""
    r = F.trim(X.col(region))
    made = lambda province, city=None: F.struct(F.lit("中国").alias("country"), province.alias("province"), F.coalesce(F.nullif(city, F.lit("")) if city is not None else F.lit(None).cast("string"), F.lit(UNKNOWN)).alias("city"))
    part = lambda pattern, g=1: F.regexp_extract(r, pattern, g)
    none = F.struct(F.lit(UNKNOWN).alias("country"), F.lit(UNKNOWN).alias("province"), F.lit(UNKNOWN).alias("city"))
    town = F.regexp_replace(r, "^(上海|北京|天津|重庆).", "")
    district = F.coalesce(F.nullif(F.regexp_extract(town, "^([^区]+区)", 1), F.lit("")), F.nullif(F.regexp_extract(town, "^([^县]+县)", 1), F.lit("")))
    district = F.when(town.rlike("^[^区]*[校小]区"), F.nullif(F.regexp_extract(town, "^([^县]+县)", 1), F.lit(""))).otherwise(district)
    return (
        F.when(r == "局域网", made(F.lit("上海市")))
        .when(r.rlike("^[^省]+省"), made(part("^([^省]+省)"), part("^[^省]+省([^市]*市)")))
        .when(r.startswith("内蒙"), made(F.lit("内蒙古自治区"), part("^内蒙.([^市]+市)")))
        .when(r.rlike("^(广西|西藏|宁夏|新疆)"), made(F.substring(r, 1, 2), part("^..([^市]+市)")))
        .when(r.rlike("^(上海|北京|天津|重庆)"), made(F.concat(F.substring(r, 1, 2), F.lit("市")), district))
        .when(r.rlike("^(香港|澳门)"), made(F.concat(F.substring(r, 1, 2), F.lit("特别行政区"))))
        .otherwise(none)
    )


def row_key(m: Column | str, event: str | None = None) -> Column:
    """`s_time_n`: n is a checksum of user, member and event, below 10^8. A fixed event gives the older keys."""
    m = X.col(m)
    get = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    name = F.lit(event) if event else get("en")
    return F.concat_ws("_", get("s_time"), (F.crc32(F.concat(get("u_ud"), get("u_mid"), name).cast("binary")) % 100_000_000).cast("string"))


def event_name(alias: Column | str) -> Column:
    """What an event's short name stands for; null if it is unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv]), X.col(alias))


def parsed(lines: DataFrame, observation: Observation | None = None) -> DataFrame:
    """(m: fields) of the readable lines (`value`); an observation gets `lines` and `dropped`.

    Unreadable lines go where the parts are exploded. A filter would be pushed below what makes the lines, which
    would then be made once more for each time that the condition names them, by code too long to be compiled.
    """
    if observation is not None:
        lines = lines.observe(observation, F.count(F.lit(1)).alias("lines"), F.count_if(~readable("value")).alias("dropped"))
    split = F.filter(F.array(F.split("value", r"\^A")), whole)
    return lines.select(F.explode(split).alias("parts")).select(fields_of(F.col("parts")).alias("m"))


def enriched(lines: DataFrame, ranges: DataFrame, observation: Observation | None = None) -> DataFrame:
    """(row_key, m): fields with browser, system and region added, ready for a sink."""
    read = parsed(lines, observation)
    told = ranges.withColumn("region", region_parts("region"))  # once for each range
    read = located(read.withColumn("ip", F.try_element_at("m", F.lit("ip"))), told)
    place, agent = F.coalesce("region", region_parts(F.lit(None).cast("string"))), user_agent(F.try_element_at("m", F.lit("b_iev")))
    more = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in [*((k, place[k]) for k in ("country", "province", "city")), *((k, agent[k]) for k in ("browser", "browser_v", "os", "os_v"))]])
    own = F.map_filter("m", lambda k, v: ~k.isin("country", "province", "city", "browser", "browser_v", "os", "os_v"))
    m = F.map_concat(own, F.map_from_entries(F.filter(more, lambda x: x["value"].isNotNull())))
    return read.select(row_key("m").alias("row_key"), m.alias("m"))


def store(spark: SparkSession, path: str) -> Batches:
    """A store of fields by row key in Parquet files: rows are dealt to buckets by key, and a later batch's row replaces an earlier one."""
    return Batches(spark, path, "row_key string, m map<string, string>", ["row_key"], part="bucket", part_of=f"pmod(hash(row_key), {BUCKETS})")


def save(fields: DataFrame, table: Batches, batch: int) -> None:
    """One batch of (row_key, m) into the store; of lines with one key the one with the greatest fields, compared as sorted lists, stays."""
    entries = F.array_sort(F.map_entries("m"))
    put_rows(fields.withColumn("entries of", entries), table, batch, ["`entries of`"])
