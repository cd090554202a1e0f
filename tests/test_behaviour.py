"""Stateful streams: what they keep, drop and agree on with batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import oracle
from pyspark.sql import functions as F

from footfall import sources
from footfall.operators import visits
from footfall.plans import streams
from footfall.streaming import behaviour

START = datetime(2024, 1, 1, 8)
EVENT = "user_id long, ts timestamp, event_id long"


def at(minutes):
    return START + timedelta(minutes=minutes)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def streamed(spark, folder, batches, schema):
    """One file for each micro-batch."""
    for i, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return sources.parquet_stream(spark, f"{folder}/*", maxFilesPerTrigger="1")


def ended(stream, folder):
    behaviour.appended(stream, str(folder / "out")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(folder / "out"))


def test_visits_of_batch_and_stream_agree(spark, tmp_path):
    """Gaps of just the limit, a visit that a later event joins to another, one user's equal times, rows without user or time."""
    batches = [
        [(1, at(0), 1), (1, at(30), 2), (1, at(61), 3), (2, at(0), 4), (2, at(0), 5), (None, at(5), 6), (3, None, 7)],
        [(2, at(50), 8), (2, at(25), 9), (1, at(500), 10), (4, at(20), 11)],
        [(4, at(510), 12), (9, at(5000), 13)],
        [(9, at(9000), 14)],
    ]
    found = ended(behaviour.visits(streamed(spark, tmp_path / "in", batches, EVENT)), tmp_path).filter("user_id < 9")
    batch = visits.gap_visits(spark.createDataFrame([r for b in batches for r in b], EVENT)).filter("user_id < 9")
    want = [(1, at(0), at(30), 2), (1, at(61), at(61), 1), (1, at(500), at(500), 1), (2, at(0), at(50), 4), (4, at(20), at(20), 1), (4, at(510), at(510), 1)]
    assert rows(batch.select("user_id", "start", "end", "n")) == rows(spark.createDataFrame(want, batch.select("user_id", "start", "end", "n").schema))
    assert rows(found) == rows(batch.select(*found.columns))


def test_late_events_are_in_no_visit(spark, tmp_path):
    """What comes more than the allowed time after later events is dropped, and what comes in time isn't."""
    batches = [[(1, at(0), 1), (2, at(200), 2)], [(9, at(200), 7)], [(1, at(10), 3), (2, at(145), 4)], [(9, at(5000), 5)], [(9, at(9000), 6)]]
    found = ended(behaviour.visits(streamed(spark, tmp_path / "in", batches, EVENT), late="1 hour"), tmp_path).filter("user_id < 9")
    # the watermark is at minute 140 after the first batch; a batch drops what was late before the one before it ended
    assert rows(found.select("user_id", "start", "n")) == rows(spark.createDataFrame([(1, at(0), 1), (2, at(145), 1), (2, at(200), 1)], "user_id long, start timestamp, n long"))


def test_busy_keys_are_summed_before_they_are_dealt(spark):
    """One user with very many events in a day has a row for each half hour after the first sum."""
    many = spark.range(50_000).select(F.floor(F.col("id") / 1e9 + 1).alias("user_id"), F.timestamp_millis(F.lit(1704067200000) + F.col("id") * 1000).alias("ts"))
    assert [(r.user_id, r.n) for r in visits.gap_visits(many).collect()] == [(1, 50_000)]
    plan = visits.gap_visits(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Window") and plan.count("Exchange hashpartitioning") == 2  # plans are printed from their end


CLICK = "user_id long, ad_id long, ts timestamp"


def listings(spark, tmp_path, batches, **how):
    end = [[(9, 1, at(60 * 24 * 30))], [(9, 1, at(60 * 24 * 60))]]
    return ended(behaviour.listings(streamed(spark, tmp_path / "in", batches + end, CLICK), **how), tmp_path).filter("user_id < 9")


def test_listings_expire_and_begin_anew(spark, tmp_path):
    day = 24 * 60
    batches = [
        [(1, 5, at(0)), (1, 5, at(1)), (1, 6, at(2)), (2, 5, at(3)), (None, 5, at(3)), (1, None, at(3)), (1, 5, None)],
        [(1, 5, at(4)), (1, 6, at(5)), (1, 6, at(6)), (2, 5, at(7)), (2, 5, at(day))],  # user 1 is listed at 4; what follows counts nothing
        [(1, 6, at(4 + 120)), (1, 6, at(5 + 120))],  # free again, and counting from nothing
        [(1, 6, at(6 + 120)), (2, 5, at(day + 1)), (2, 5, at(day + 2))],
    ]
    found = listings(spark, tmp_path, batches, threshold=3, lasts=timedelta(hours=2), late="2 days")
    want = [(1, "listed", 5, at(4), at(124)), (1, "released", None, at(124), None), (1, "listed", 6, at(126), at(246)), (1, "released", None, at(246), None),
            (2, "listed", 5, at(day + 2), at(day + 122)), (2, "released", None, at(day + 122), None)]
    assert rows(found) == rows(spark.createDataFrame(want, behaviour.LISTINGS))


def test_listing_state_goes_with_time(spark, tmp_path):
    """Counts of days that are over and lists that have expired leave the state, also of users who never come back."""
    batches = [[(u, 1, at(u)) for u in range(8)] * 2, [(9, 1, at(60 * 24 * 3))], [(9, 2, at(60 * 24 * 9))], [(9, 3, at(60 * 24 * 20))]]
    stream = behaviour.listings(streamed(spark, tmp_path / "in", batches, CLICK), threshold=2, lasts=timedelta(hours=2))
    query = behaviour.appended(stream, str(tmp_path / "out"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 8 and held[-1] <= 1  # what is left is the last user's
    assert spark.read.parquet(str(tmp_path / "out")).filter("event = 'released' and user_id < 9").count() == 8


def test_listings_in_a_session_with_the_default_store(spark, sf_dir):
    """The query brings the store that it needs; the session keeps its own."""
    before = spark.conf.get(behaviour.STORE)
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(behaviour.STORE, default)
    try:
        oracle.assert_same(streams.t_listings(spark, sf_dir), streams.SQL["t_expiring_listings"], oracle.connect(sf_dir))
        assert spark.conf.get(behaviour.STORE) == default
    finally:
        spark.conf.set(behaviour.STORE, before)


def test_a_micro_batch_is_many_files_of_one_part(spark, tmp_path):
    """A part's rows are dealt to several files, as many for each part, also for one with few rows or none; batches don't mix parts."""
    df = spark.range(3000).select((F.col("id") + 1).alias("user_id"), F.timestamp_seconds(F.lit(1704067200) + F.when(F.col("id") % 100 == 0, 10).otherwise(F.when(F.col("id") == 1, 29).otherwise(2)) * 86_400).alias("ts"))
    stream = streams.in_files(df, str(tmp_path / "in"), "ts", -1, rows=500)
    files = {f"{i}": len(list((tmp_path / "in" / f"{i}").glob("*.parquet"))) for i in (0, 1, 2, 3, 5, 6)}
    assert files == dict.fromkeys(files, 6)
    seen = {}
    batches = stream.writeStream.foreachBatch(lambda b, i: seen.update({i: {tuple(r) for r in b.select(F.dayofmonth("ts"), F.least("user_id", F.lit(0))).distinct().collect()} | {b.count()}}))
    batches.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {0: {(3, 0), 2969}, 1: {(11, 0), 30}, 2: {0}, 3: {(30, 0), 1}, 4: {(29, -1), 6}, 5: {(30, -1), 6}}


def test_purchases_with_clicks_from_both_sides(spark, tmp_path):
    bought, clicked = "user_id long, purchase_id long, bought_at timestamp", "user_id long, click_id long, clicked_at timestamp"
    purchases = [[(1, 10, at(60)), (2, 11, at(61)), (None, 12, at(62))], [(1, 13, at(70)), (3, 14, at(200))], [(-1, 0, at(5000))], [(-1, 0, at(9000))]]
    clicks = [[(1, 1, at(0)), (2, 2, at(0)), (1, 3, at(60)), (None, 4, at(61))], [(2, 5, at(30)), (3, 6, at(201)), (1, 7, at(69))], [(-2, 0, at(5000))], [(-2, 0, at(9000))]]
    p, c = streamed(spark, tmp_path / "p", purchases, bought), streamed(spark, tmp_path / "c", clicks, clicked)
    found = ended(behaviour.attributed(p, c, late="2 hours"), tmp_path).filter("user_id is null or user_id >= 0")
    pairs = [(r.purchase_id, r.click_id) for r in found.collect()]
    # an hour before counts, what comes after the purchase doesn't; the click of minute 30 came later than its purchase
    assert sorted(pairs, key=str) == sorted([(10, 1), (10, 3), (11, 5), (12, None), (13, 3), (13, 7), (14, None)], key=str)


def test_messages_that_are_sent_again(spark, tmp_path):
    first = [(1, at(0), 1), (1, at(1), 2), (1, at(1), 2), (2, at(2), None)]
    batches = [first, [(2, at(5), 3), *first], first, [(1, at(5000), 4)], [(1, at(5000), 4)], [(1, at(4990), 1)], first]
    found = ended(behaviour.once(streamed(spark, tmp_path / "in", batches, EVENT), ["event_id"]), tmp_path)
    # an id that comes anew long after is another message; the file that comes again at the end is late
    assert rows(found.select("event_id", "ts")) == rows(spark.createDataFrame([(1, at(0)), (2, at(1)), (None, at(2)), (3, at(5)), (4, at(5000)), (1, at(4990))], "event_id long, ts timestamp"))
