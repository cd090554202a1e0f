"""Streams against batches, replays, and the sinks."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall import sources
from footfall.operators import ads
from footfall.sources import sinks
from footfall.streaming import ads as jobs

START = datetime(2024, 1, 1, 8)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def stream_of(spark, folder, batches):
    """A stream that gets one file of clicks in each micro-batch."""
    for i, clicks in enumerate(batches):
        spark.createDataFrame(clicks, sources.AD_CLICK).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return sources.parquet_stream(spark, f"{folder}/*", maxFilesPerTrigger="1")


def click(user, ad, minutes=0, city="c"):
    return (START + timedelta(minutes=minutes), "p", city, user, ad)


def test_blacklist_feeds_the_next_batch(spark, tmp_path):
    batches = [[click(1, 1)] * 3 + [click(2, 1)] * 2, [click(1, 1)] * 5 + [click(2, 1)]]
    job = jobs.user_counts(spark, stream_of(spark, tmp_path / "in", batches), str(tmp_path / "out"), threshold=3).wait()
    counts = job.tables["counts"].summed(["user_id", "ad_id"], "click_count")
    assert rows(counts) == [(1, 1, 3), (2, 1, 3)]  # user 1 is listed after the first batch, user 2 after the second
    assert rows(job.tables["blacklist"].read().select("user_id")) == [(1,), (2,)]


def test_running_counts_and_top(spark, tmp_path):
    batches = [[click(u, u % 4, city=f"c{u % 2}") for u in range(9)], [click(u, 3) for u in range(5)], [click(1, 9, minutes=60 * 24)]]
    job = jobs.running_counts(spark, stream_of(spark, tmp_path / "in", batches), str(tmp_path / "out")).wait()
    clicks = spark.createDataFrame([c for b in batches for c in b], sources.AD_CLICK)
    assert rows(job.tables["counts"].latest(["date", "province", "city", "ad_id"])) == rows(ads.running_counts(clicks))
    assert rows(job.tables["top"].latest(["date", "province"])) == rows(ads.province_top(ads.running_counts(clicks)))


def test_trend(spark, tmp_path):
    batches = [[click(1, 1), click(1, 1, 5)], [click(1, 1, 8), click(2, 2, 70)]]
    job = jobs.trend(spark, stream_of(spark, tmp_path / "in", batches), str(tmp_path / "out"), "60 minutes", "10 minutes").wait()
    clicks = spark.createDataFrame([c for b in batches for c in b], sources.AD_CLICK)
    assert rows(job.tables["trend"].latest(["window_start", "window_end", "ad_id"])) == rows(ads.trend(clicks, "60 minutes", "10 minutes"))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = sinks.Batches(spark, str(tmp_path / "t"), "k string, n long")
    for batch, data in ((0, [("a", 1)]), (1, [("a", 2), ("b", 3)]), (1, [("a", 2), ("b", 3)])):
        table.write(spark.createDataFrame(data, "k string, n long"), batch)
    assert rows(table.summed(["k"], "n")) == [("a", 3), ("b", 3)]
    assert rows(table.summed(["k"], "n", before=1)) == [("a", 1)]
    assert rows(table.latest(["k"])) == [("a", 2), ("b", 3)]


def test_merged_batches_read_the_same(spark, tmp_path):
    """Sums and latest rows with and without merging, at each batch and where one runs again after a merge."""
    data = [[(f"2024-01-0{1 + i % 3}", k, i) for k in range(i % 3, 4)] for i in range(11)]
    schema, keys = "date string, k long, n long", ["date", "k"]
    make = lambda name, **more: sinks.Batches(spark, str(tmp_path / name), schema, **more)
    plain, added, last = make("plain"), make("added", keys=keys, value="n", part="date", every=3), make("last", keys=keys, every=3)
    for i, batch in enumerate(data):
        for table in (plain, added, last):
            for _ in range(2 if i in (5, 6) else 1):
                table.write(spark.createDataFrame(batch, schema), i)
        assert rows(added.summed(keys, "n")) == rows(plain.summed(keys, "n")) and rows(last.latest(keys)) == rows(plain.latest(keys))
        assert rows(added.summed(keys, "n", before=i)) == rows(plain.summed(keys, "n", before=i))
    assert added.folders("upto") == [5, 8] and added.folders("batch") == [-1, 6, 7, 8, 9, 10]


def test_a_merge_rewrites_touched_parts_only(spark, tmp_path):
    """Days, an expression's parts and a null day: what no batch has touched stays in the folder of an earlier merge."""
    schema, keys = "date string, k long, n long", ["date", "k"]
    batches = [[("d1", 1, 1), ("d2", 1, 1), (None, 1, 1)], [("d1", 2, 5)], [("d2", 1, 7)], [("d2", 3, 7)], [("d3", 1, 1), (None, 2, 2)], [("d3", 1, 4)]]
    make = lambda name, **more: sinks.Batches(spark, str(tmp_path / name), schema, keys, every=2, **more)
    days, thirds, whole, added = make("days", part="date"), make("thirds", part="third", part_of="k % 3"), make("whole"), make("added", part="date", value="n")
    plain = sinks.Batches(spark, str(tmp_path / "plain"), schema)
    for i, batch in enumerate(batches):
        for table in (days, thirds, whole, added, plain):
            table.write(spark.createDataFrame(batch, schema), i)
        by_text = lambda df: sorted(map(str, df.collect()))
        for table in (days, thirds, whole) if i > 2 else ():
            assert by_text(table.latest(keys)) == by_text(plain.latest(keys)), i
    assert by_text(added.summed(keys, "n")) == by_text(plain.summed(keys, "n"))
    assert days.parts() == {"date=d1": [1], "date=d2": [3], "date=d3": [5], "date=__HIVE_DEFAULT_PARTITION__": [1, 5]}
    assert thirds.parts()["third=1"] == [3, 5] and thirds.parts()["third=2"] == [1, 5] and thirds.parts()["third=0"] == [3]


def test_a_merge_without_its_mark_does_not_count(spark, tmp_path):
    """A merge that ended before its mark was written is as if it had not begun, and can be done again."""
    table = sinks.Batches(spark, str(tmp_path / "t"), "k long, n long", ["k"], "n", every=2)
    frame = lambda *data: spark.createDataFrame(data, "k long, n long")
    for i in range(3):
        table.write(frame((1, 1), (i, 1)), i)
    broken = frame((1, 99)).selectExpr("k", "n", "cast(3 as long) as batch", "'0' as part", "3 as upto")
    broken.write.partitionBy("part", "upto").mode("append").parquet(f"{table.path}/merged")
    want = [(0, 1), (1, 4), (2, 1)]
    assert rows(table.summed(["k"], "n")) == want
    for _ in range(2):
        table.write(frame((1, 1)), 3)
        assert rows(table.summed(["k"], "n")) == [(0, 1), (1, 5), (2, 1)]


def test_rows_by_key(spark, tmp_path):
    """A store of fields by row key: a later batch replaces a row, one key's rows in a batch are one."""
    table = sinks.Batches(spark, str(tmp_path / "t"), "row_key string, m map<string, string>", ["row_key"], part="bucket", part_of="pmod(hash(row_key), 4)", every=2)
    put = lambda batch, *data: sinks.put_rows(spark.createDataFrame(data, "row_key string, m map<string, string>, t long"), table, batch, ["t"])
    put(0, ("a", {"x": "1"}, 1), ("a", {"x": "2"}, 2), ("b", {}, 1))
    put(1, ("b", {"y": "3"}, 1), ("c", None, 1))
    put(2, ("a", {"x": "4", "z": "5"}, 1))
    assert {r.row_key: r.m for r in table.latest(["row_key"]).collect()} == {"a": {"x": "4", "z": "5"}, "b": {"y": "3"}, "c": None}


def test_minutes_are_replaced(spark, tmp_path):
    batches = [[click(1, 1), click(2, 1)], [click(3, 1), click(1, 2, 1)]]
    job = jobs.minute_counts(spark, stream_of(spark, tmp_path / "in", batches), str(tmp_path / "out")).wait()
    assert rows(job.tables["minutes"].latest(["date", "hour", "minute", "ad_id"])) == [("2024-01-01", "08", "00", 1, 3), ("2024-01-01", "08", "01", 2, 1)]


def test_slides_of_ten_seconds(spark, tmp_path):
    """Counted by slide first, the windows are those that each click is in."""
    clicks = spark.createDataFrame([(START + timedelta(seconds=s), "p", "c", 1, s % 2) for s in (0, 3, 10, 19, 4000)], sources.AD_CLICK)
    direct = clicks.groupBy(F.window("ts", "60 minutes", "10 seconds").alias("w"), "ad_id").agg(F.count("*").alias("n"))
    assert rows(ads.trend(clicks)) == rows(direct.select("w.start", "w.end", "ad_id", "n"))
    assert ads.trend(clicks).count() > 1000


def test_console(spark, capfd):
    sinks.to_console(spark.range(2))
    assert "|0  |" in capfd.readouterr().out


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="share"):
        sinks.shared_folder(Cluster())


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "g string, k int, n long")
    new = spark.createDataFrame([("a", 1, 10), ("c", 1, 5)], "g string, k int, n long")
    assert rows(sinks.upsert(old, new, ["g", "k"])) == [("a", 1, 10), ("a", 2, 2), ("b", 1, 3), ("c", 1, 5)]
    assert rows(sinks.add_up(old, new, ["g", "k"], "n")) == [("a", 1, 11), ("a", 2, 2), ("b", 1, 3), ("c", 1, 5)]
    assert rows(sinks.replace_groups(old, new, ["g"])) == [("a", 1, 10), ("b", 1, 3), ("c", 1, 5)]
    assert rows(sinks.upsert(old, new.limit(0), ["g", "k"])) == rows(old)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n long")
    sinks.append(df, str(tmp_path / "p"), by=["g"])
    sinks.append(df, str(tmp_path / "p"), by=["g"])
    assert rows(spark.read.parquet(str(tmp_path / "p")).select("g", "n")) == rows(df.union(df))
    sinks.save_json(df, str(tmp_path / "j"))
    assert rows(sources.json_lines(spark, str(tmp_path / "j"), df.schema)) == rows(df)
    assert sources.text_lines(spark, str(tmp_path / "j" / "*.json")).count() == 2
    sinks.save_table(df, "saved")
    assert rows(spark.table("saved")) == rows(df)


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.range(20).selectExpr("id as k", "id % 3 as g")
    sinks.append_jdbc(df, url, "t", driver=driver)  # Spark's own jars have the database
    assert rows(sources.jdbc(spark, url, "t", driver=driver)) == rows(df)
    read = sources.jdbc(spark, url, "t", ("K", 0, 20, 4), driver=driver)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 20
