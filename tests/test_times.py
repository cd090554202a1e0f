"""As-of and overlap joins, ranks and rolling counts against brute force, with busy keys and odd rows."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import intervals, ranks, slices, visits

START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("values", [[], [5], [3, 3, 3], list(range(-50, 60, 7)), [0, 1, 2, 3, 10**12, 10**12 + 1], [0.5, 0.1 + 0.2, 0.3, 1e-9, 7.25]])
def test_slices_are_in_order(spark, values):
    edges = sorted(set(values))
    some = [v + d for v in edges for d in (-1, 0, 1)] or [4]
    kind = "double" if any(isinstance(v, float) for v in some) else "long"
    df = spark.createDataFrame([(v,) for v in [*map(float if kind == "double" else int, some), None]], f"v {kind}")
    for r in df.select("v", slices.slice_of("v", edges).alias("s")).collect():
        assert r.s == (0 if r.v is None else 2 * sum(e < r.v for e in edges) + (r.v in edges))


LEFT, RIGHT = "k string, j int, t timestamp, id long, r string", "k string, j int, t timestamp, seen long, extra string"


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), rng.choice([1, 1, 2]), at(rng.choice([*range(0, 4000, 3), None])), i, "x") for i in range(400)]
    right = [(key(), rng.choice([1, 1, 2]), at(rng.choice([*range(0, 4000, 5), None])), i, f"e{i}") for i in range(500)]
    return left, right + right[:20] + [("hot", 1, at(600), 9000 + i, None) for i in range(150)]  # many right rows at one time


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, "40 minutes"])
@pytest.mark.parametrize("pieces", [1, 7, 64])
def test_asof(spark, both, strict, tolerance, pieces):
    left, right = both
    want = []
    for k, j, t, i, x in left:
        near = [(u, seen, extra) for a, b, u, seen, extra in right if k is not None and (a, b) == (k, j) and t is not None and u is not None and (u < t if strict else u <= t)]
        best = max(near, key=lambda n: n[:2], default=None)
        if best and tolerance and t - best[0] > timedelta(minutes=40):
            best = None
        want.append((k, j, t, i, x, *((best[1], best[0], best[2]) if best else (None, None, None))))
    df = intervals.asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT).withColumnRenamed("t", "u"), ["k", "j"], "t", "u", ["seen", "u", "extra"], ["seen"], tolerance, strict, pieces)
    assert df.columns == ["k", "j", "t", "id", "r", "seen", "u", "extra"] and rows(df) == sorted(want, key=str)


def test_asof_of_nothing(spark, both):
    left, right = spark.createDataFrame(both[0], LEFT), spark.createDataFrame(both[1], RIGHT).withColumnRenamed("t", "u")
    join = lambda a, b: intervals.asof(a, b, ["k", "j"], "t", "u", ["seen"], ["seen"])
    assert join(left.limit(0), right).count() == 0
    assert rows(join(left, right.limit(0))) == rows(left.withColumn("seen", F.lit(None).cast("long")))


def test_a_busy_key_is_many_slices(spark):
    """One key with all rows, half of them in one minute: no slice has more than a few times its share."""
    n = 20_000
    times = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id") % 60_000_000 * 3000).otherwise(F.col("id") * 10_000_000).alias("at"))
    found = slices.edges(times, "at", 50)
    sizes = times.groupBy(slices.slice_of("at", found).alias("s")).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 3 * n / 50 and sizes[1] >= 40


INTERVAL = "g string, id string, s timestamp, e timestamp"


def pairs_of(data):
    whole = [(g, i, s, e) for g, i, s, e in data if g is not None and i is not None and s is not None and e is not None and s <= e]
    return sorted((g, min(i, j), max(i, j), max(s, t), min(e, f)) for n, (g, i, s, e) in enumerate(whole) for h, j, t, f in whole[:n] if g == h and s <= f and t <= e)


@pytest.mark.parametrize("base", [None, "1 minute", "3 hours", "100 days"])
def test_overlaps(spark, base):
    rng = random.Random(9)
    data = []
    for i in range(260):
        s = rng.randrange(5000)
        length = rng.choice([0, 0, 1, 5, 30, 31, 64, 500, 20_000])  # some last longer than all others together
        data.append((rng.choice(["hot"] * 5 + ["a", None]), f"v{i}", at(s), at(s + length)))
    data += [("a", "x1", at(10), at(5)), ("a", "x2", None, at(5)), ("a", "x3", at(5), None), ("a", None, at(1), at(9)), ("b", "alone", at(1), at(2))]
    data += [("c", "p", at(0), at(60)), ("c", "q", at(60), at(90)), ("c", "r", at(91), at(92))]  # one shared moment is an overlap
    assert rows(intervals.overlaps(spark.createDataFrame(data, INTERVAL), "g", "s", "e", "id", base)) == sorted(pairs_of(data), key=str)


def test_overlaps_of_few(spark):
    df = spark.createDataFrame([("a", "x", at(1), at(1))], INTERVAL)
    assert intervals.overlaps(df, "g", "s", "e", "id").count() == 0 and intervals.overlaps(df.limit(0), "g", "s", "e", "id").count() == 0
    before = spark.createDataFrame([("a", "x", datetime(1960, 1, 1), datetime(1960, 1, 3)), ("a", "y", datetime(1960, 1, 2), datetime(1980, 1, 1))], INTERVAL)
    assert [(r.a, r.b) for r in intervals.overlaps(before, "g", "s", "e", "id").collect()] == [("x", "y")]


def test_long_intervals_are_not_cut_up(spark):
    """An interval that lasts a thousand times the usual length has a row or two for each level, not a thousand."""
    data = [("a", f"v{i:04d}", at(i), at(i + 1)) for i in range(400)] + [("a", "long", at(0), at(400))]
    df = intervals.overlaps(spark.createDataFrame(data, INTERVAL), "g", "s", "e", "id", "1 minute")
    assert df.count() == 399 + 400


def written(plan):
    """Rows that a plan's exchanges wrote, each exchange once."""
    rows, todo, seen = 0, [plan], set()
    while todo:
        p = todo.pop()
        kind, children = p.getClass().getSimpleName(), p.children()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif kind == "ShuffleExchangeExec" and p.id() not in seen:
            seen.add(p.id())
            rows += p.metrics().get("shuffleRecordsWritten").get().value()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_many_lengths_take_few_rows(spark):
    """Most intervals are moments and the rest has all lengths: each is shuffled a few times, not once for each length, and the pairs that share an interval, and those without length, follow each other."""
    rng = random.Random(5)
    lengths = [0] * 3600 + [2**k + rng.randrange(2**k) for k in range(10, 34) for _ in range(50)]
    rng.shuffle(lengths)
    data = [("a", f"{i * 7919 % 100_003:09d}_{1_704_067_200_000_000 + b}", b, b + n) for i, n in enumerate(lengths) for b in [rng.randrange(2**36)]]
    df = spark.createDataFrame(data, "g string, id string, s long, e long").select("g", "id", F.timestamp_micros("s").alias("s"), F.timestamp_micros("e").alias("e"))
    out = intervals.overlaps(df, "g", "s", "e", "id").select("g", "a", "b", (F.unix_micros("until") - F.unix_micros("from")).alias("micros"))
    found = out.collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted((("a", min(i, j), max(i, j), min(e, f) - max(s, t)) for n, (_, i, s, e) in enumerate(data) for _, j, t, f in data[:n] if s <= f and t <= e), key=str)
    alone, moments = (sum(x.a != y.a and x.b != y.b for x, y in zip(found, found[1:])), sum((x.micros == 0) != (y.micros == 0) for x, y in zip(found, found[1:])))
    assert alone < len(found) / 5 and moments < len(found) / 5
    assert written(out._jdf.queryExecution().executedPlan()) < 6 * len(data)


def test_very_long_intervals_just_over_a_power_of_two(spark):
    """The logarithms of these lengths are rounded, some of them to the power itself."""
    lengths = [2**k + d for k in range(48, 54) for d in (0, 1, 2)]
    data = [(f"g{k}", f"v{k}_{i}", 5 * i, 5 * i + n) for k in range(0, len(lengths), 3) for i, n in enumerate(lengths[k : k + 3])] + [("all", f"w{n}", 0, n) for n in lengths]
    for k in (slice(None), slice(0, 3), slice(6, 9), slice(9, 18)):
        df = spark.createDataFrame(data[k], "g string, id string, s long, e long").select("g", "id", F.timestamp_micros("s").alias("s"), F.timestamp_micros("e").alias("e"))
        want = sum(x[0] == y[0] for n, x in enumerate(data[k]) for y in data[k][:n])
        assert intervals.overlaps(df, "g", "s", "e", "id").count() == want > 0


@pytest.mark.parametrize("pieces", [1, 5, 40])
def test_ranks(spark, pieces):
    rng = random.Random(2)
    values = [rng.choice([7] * 5 + [-3, 0, 2**40, rng.randrange(100), None]) for _ in range(700)]  # one value holds a half
    df = spark.createDataFrame([(i, v, "k") for i, v in enumerate(values)], "id long, v long, extra string").repartition(5)
    for descending in (False, True):
        want = df.filter("v is not null").createOrReplaceTempView("v") or spark.sql(f"""select id, v, extra, row_number() over a as position, rank() over b as rank, percent_rank() over b as percent_rank, cume_dist() over b as cume_dist, ntile(13) over a as tile, sum(v) over a as running
          from v window a as (order by v {"desc" if descending else ""}, id), b as (order by v {"desc" if descending else ""})""")
        got = ranks.ranked(df, "v", "id", 13, descending, pieces)
        assert rows(got.filter("v is not null")) == rows(want) and got.filter("v is null and tile is null and rank is null").count() == values.count(None)


def test_ranks_of_few(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, v long")
    assert rows(ranks.ranked(df, "v", "id", 4)) == [(1, 5, 1, 1, 0.0, 1.0, 1, 5), (2, None, None, None, None, None, None, None)]
    assert ranks.ranked(df.limit(0), "v", "id").count() == 0
    assert [r.tile for r in ranks.ranked(spark.range(3).select("id", F.col("id").alias("v")), "v", "id", 100).orderBy("position").collect()] == [1, 2, 3]


def test_rolling_users(spark):
    rng = random.Random(3)
    data = [(rng.choice(["p", "q"]), rng.choice([1, 1, 1, 2, 3, None]), date(2024, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 9, 16, 17, 25, 60]))) for _ in range(60)] + [("p", 1, None)]
    df = spark.createDataFrame(data, "g string, user_id long, date date")
    for days, by in ((7, ("g",)), (1, ()), (30, ())):
        want = []
        for g in ("p", "q") if by else (None,):
            own = [(u, d) for h, u, d in data if u is not None and d is not None and g in (None, h)]
            day, last = min(d for _, d in own), max(d for _, d in own)
            while day <= last:
                want.append((*([g] if by else []), day, len({u for u, d in own if timedelta(0) <= day - d < timedelta(days=days)})))
                day += timedelta(days=1)
        assert rows(visits.rolling_users(df, days, by)) == sorted(want, key=str)
    assert visits.rolling_users(df.limit(0)).count() == 0
