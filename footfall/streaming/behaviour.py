"""Behaviour on a stream of events: visits, expiring lists, attributed purchases, messages that are sent again.

Each function takes and returns a streaming DataFrame that only ever appends rows: a row leaves when the
watermark says that nothing can change it any more. `late` is how long a row may come after
later ones; what comes later than that is dropped, from the second micro-batch after the later rows on (the one
between still takes it). State is bounded by it: it holds what is open, not what is done.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from footfall.operators.visits import GAP, LATE

#: Spark's default store holds one table for each state; jobs whose state is several tables need this one.
STORE, TABLES = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LISTINGS = "user_id long, event string, ad_id long, at timestamp, until timestamp"


def appended(stream: DataFrame, path: str, every: str | None = None, tables: bool = False) -> StreamingQuery:
    """A query that adds the stream's rows to Parquet files, each row once; what is there is read until its end unless `every` is given.

    `tables` starts it with the store that `listings` needs, whichever the session has; the session keeps its own.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    if tables:
        conf.set(STORE, TABLES)
    try:
        return started(stream, path, every)
    finally:
        if tables and before is None:
            conf.unset(STORE)
        elif tables:
            conf.set(STORE, before)


def started(stream: DataFrame, path: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.checkpoint").outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def visits(events: DataFrame, gap: str = GAP, late: str = LATE, by: str = "user_id", at: str = "ts") -> DataFrame:
    """(by, start, end, n) as operators.visits.gap_visits gives them, each once it is over.

    State is an open visit for each key; an event that two visits reach merges them. An event that is
    dropped as late doesn't join them either.
    """
    known = events.filter(F.col(by).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    merged = known.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.max(at).alias("end"), F.count("*").alias("n"))
    return merged.select(by, F.col("w.start").alias("start"), "end", "n")


class Listing(StatefulProcessor):
    """Lists a user who clicks one ad too often on a day, for some time, and lets them go again.

    Counts by day and ad are kept until the day is over, and the time until which a user is listed until it
    has come; timers of event time clear both, so a user who stays away leaves no state. While
    listed, a user's clicks count nothing, and counting starts anew afterwards. A user's clicks are taken in order
    of time within each portion that Spark hands over.
    """

    def __init__(self, threshold: int, lasts: timedelta) -> None:
        self.threshold, self.lasts = threshold, lasts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "day long, ad_id long", "n long")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for portion in rows:
            out = []
            for at, ad in portion.sort_values(["ts", "ad_id"])[["ts", "ad_id"]].itertuples(index=False):
                ms = at.value // 1_000_000
                if self.until.exists():
                    if ms < self.until.get()[0]:
                        continue
                    yield self.released(key)
                count = (ms // 86_400_000, int(ad))
                n = (self.counts.getValue(count)[0] if self.counts.containsKey(count) else 0) + 1
                if n < self.threshold:
                    self.counts.updateValue(count, (n,))
                    self.handle.registerTimer((count[0] + 1) * 86_400_000)
                    continue
                until = at + self.lasts
                self.counts.clear()
                self.until.update((until.value // 1_000_000,))
                self.handle.registerTimer(until.value // 1_000_000)
                out.append((key[0], "listed", int(ad), at, until))
            if out:
                yield pd.DataFrame(out, columns=["user_id", "event", "ad_id", "at", "until"])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] <= now:
            yield self.released(key)
        for count in [tuple(k) for k in self.counts.keys() if (k[0] + 1) * 86_400_000 <= now]:
            self.counts.removeKey(count)

    def released(self, key: Any) -> pd.DataFrame:
        until = pd.Timestamp(self.until.get()[0], unit="ms")
        self.until.clear()
        return pd.DataFrame([(key[0], "released", None, until, None)], columns=["user_id", "event", "ad_id", "at", "until"]).astype({"ad_id": "Int64", "until": "datetime64[ns]"})

    def close(self) -> None:
        pass


def listings(clicks: DataFrame, threshold: int = 100, lasts: timedelta = timedelta(hours=24), late: str = LATE) -> DataFrame:
    """(user_id, event, ad_id, at, until): `listed` when a user's clicks of an ad reach the threshold on a day, `released` when that has expired.

    Its state is several tables: start it by `appended(..., tables=True)`, or in a session whose state store is RocksDB.
    Times are in whole milliseconds, days in UTC. Clicks without a user, an ad or a time are left out.
    """
    whole = clicks.filter("user_id is not null and ad_id is not null and ts is not null").select("user_id", "ad_id", F.timestamp_millis(F.unix_millis("ts")).alias("ts"))
    return whole.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(Listing(threshold, lasts), LISTINGS, "Append", "EventTime")


def attributed(purchases: DataFrame, clicks: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """Purchases (user_id, purchase_id, bought_at) with each click (user_id, click_id, clicked_at) of the user at most `within` before.

    Either side may come first: both wait in state until the other's watermark has passed what could
    still match. A purchase without a click leaves then, with nulls. Purchases without a user have none.
    """
    p, c = purchases.withWatermark("bought_at", late).alias("p"), clicks.withWatermark("clicked_at", late).alias("c")
    on = F.expr(f"p.user_id = c.user_id and clicked_at <= bought_at and clicked_at >= bought_at - interval {within}")
    return p.join(c, on, "left_outer").select("p.user_id", "purchase_id", "bought_at", "click_id", "clicked_at")


def once(messages: DataFrame, ids: list[str], late: str = LATE, at: str = "ts") -> DataFrame:
    """The messages without those whose ids were seen before; an id is forgotten when the watermark passes its message's time by `late`."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)
