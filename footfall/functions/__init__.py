"""Scalar helpers: every one takes and returns columns and stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it; lambdas' bodies share nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# strings


def is_empty(c: Column | str) -> Column:
    """Null or the empty string."""
    return F.coalesce(col(c), F.lit("")) == ""


def is_not_empty(c: Column | str) -> Column:
    return ~is_empty(c)


def trim_comma(c: Column | str) -> Column:
    """Without one leading and one trailing comma."""
    return F.regexp_replace(col(c), "^,|,$", "")


def two_digits(c: Column | str) -> Column:
    """One zero in front unless there are two characters."""
    c = col(c).cast("string")
    return F.when(F.length(c) == 2, c).otherwise(F.concat(F.lit("0"), c))


def field_of(c: Column | str, name: str, delimiter: str = "|") -> Column:
    """Value of the first `name=value` among delimited parts; null if it is missing or empty."""
    parts = F.split(col(c), rf"\Q{delimiter}\E")
    pairs = F.filter(F.transform(parts, lambda p: F.split(p, "=", -1)), lambda p: (F.size(p) == 2) & (p[0] == name))
    return F.nullif(F.get(F.transform(pairs, lambda p: p[1]), F.lit(0)), F.lit(""))


def with_field(c: Column | str, name: str, value: Column | str, delimiter: str = "|") -> Column:
    """The delimited parts with the value of `name` replaced."""
    value = F.lit(value) if isinstance(value, str) else value
    parts = F.split(col(c), rf"\Q{delimiter}\E")
    new = F.transform(parts, lambda p: F.when(F.substring_index(p, "=", 1) == name, F.concat(F.lit(f"{name}="), value)).otherwise(p))
    return F.array_join(new, delimiter)


def contains(c: Column | str, part: str) -> Column:
    return col(c).contains(part)


def labelled(number: Column | str, name: Column | str, separator: str = ":") -> Column:
    """`number:name`; null if either is."""
    return F.concat(col(number).cast("string"), F.lit(separator), col(name))


def distinct_list(c: Column | str, separator: str = ",") -> Column:
    """Aggregate: the different non-null values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(col(c))), separator)


def json_field(c: Column | str, key: str) -> Column:
    """A top-level field of a JSON text as a string; null if there is none."""
    return F.get_json_object(col(c), f"$.{key}")


def json_first(c: Column | str, key: str) -> Column:
    """The first element of a JSON array field, or a scalar field's value."""
    return F.coalesce(F.get_json_object(col(c), f"$.{key}[0]"), F.get_json_object(col(c), f"$.{key}"))


def with_prefix(c: Column | str, n: int, key: Column | str | None = None) -> Column:
    """`salt_value` with a salt under n: random, or a hash of `key`, which gives the same on every run."""
    salt = F.floor(F.rand() * n) if key is None else F.pmod(F.xxhash64(col(key)), F.lit(n))
    return F.concat(salt.cast("int").cast("string"), F.lit("_"), col(c))


def without_prefix(c: Column | str) -> Column:
    """What follows the first underscore, further ones included."""
    return F.regexp_replace(col(c), "^[^_]*_", "")


# dates and times; a text that is no time gives null unless said otherwise

TIME, DATE, DATE_KEY, MINUTE_KEY, HOUR_KEY = "yyyy-MM-dd H:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "yyyyMMddHHmm", "yyyy-MM-dd_HH"


def parse_time(c: Column | str, pattern: str = TIME) -> Column:
    return F.try_to_timestamp(col(c), F.lit(pattern))


def before(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(parse_time(a) < parse_time(b), F.lit(False))


def after(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(parse_time(a) > parse_time(b), F.lit(False))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """a - b of two times as text; 0 if one can't be read."""
    return F.coalesce(F.unix_timestamp(parse_time(a)) - F.unix_timestamp(parse_time(b)), F.lit(0))


def whole_seconds(later: Column | str, earlier: Column | str) -> Column:
    """Full seconds between two timestamps."""
    return F.floor((F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / 1_000_000).cast("long")


def date_hour(c: Column | str) -> Column:
    return F.date_format(col(c), HOUR_KEY)


def date_text(c: Column | str) -> Column:
    return F.date_format(col(c), DATE)


def time_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")


def date_key(c: Column | str) -> Column:
    return F.date_format(col(c), DATE_KEY)


def minute_key(c: Column | str) -> Column:
    return F.date_format(col(c), MINUTE_KEY)


def parse_date_key(c: Column | str) -> Column:
    """Strict: a text that is no date raises."""
    return F.to_date(col(c), DATE_KEY)


def today() -> Column:
    return F.date_format(F.current_date(), DATE)


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), DATE)


def epoch_text(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds as text to a formatted time; null, empty and `null` give the empty string."""
    c = col(c).cast("string")
    return F.when(is_empty(c) | (c == "null"), F.lit("")).otherwise(F.from_unixtime(c.try_cast("long"), pattern))


def is_date(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False))


def to_millis(c: Column | str, pattern: str = DATE) -> Column:
    return F.unix_millis(parse_time(c, pattern))


def from_millis(c: Column | str, pattern: str = DATE) -> Column:
    return F.date_format(F.timestamp_millis(col(c).cast("long")), pattern)


def server_millis(c: Column | str) -> Column:
    """Epoch seconds with a fraction, as servers log them, to milliseconds; -1 if it is no number."""
    return F.coalesce(F.round(F.trim(col(c)).try_cast("decimal(20,6)") * 1000, 0).cast("long"), F.lit(-1).cast("long"))


def server_time(c: Column | str) -> Column:
    return F.when(server_millis(c) >= 0, F.timestamp_millis(server_millis(c)))


def week_of_year(c: Column | str) -> Column:
    """Weeks begin on Sunday, and the one with the first of January is week 1."""
    start = F.date_trunc("year", col(c))
    return (F.floor((F.dayofyear(col(c)) + F.dayofweek(start) - 2) / 7) + 1).cast("int")


def date_part(c: Column | str, part: str) -> Column:
    """year, season, month, week, day or hour of a timestamp."""
    parts = {"year": F.year, "season": F.quarter, "month": F.month, "week": week_of_year, "day": F.dayofmonth, "hour": F.hour}
    return parts[part.lower()](col(c))


def first_day_of_week(c: Column | str) -> Column:
    """The Sunday of the week, as a date."""
    return F.date_sub(col(c).cast("date"), F.dayofweek(col(c)) - 1)


# numbers


def ratio(n: Column | str, total: Column | str, scale: int = 2) -> Column:
    """n / total rounded half up; null for a total of 0."""
    return F.round(col(n) / F.nullif(col(total), F.lit(0)), scale)


def rounded(c: Column | str, scale: int) -> Column:
    return F.round(col(c), scale)
