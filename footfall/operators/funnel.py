"""Page-flow conversion: how often a session goes on from one page of a flow to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from footfall import functions as X


def hops(actions: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    """(session_id, page_id, before): each action with the page of the session's action before it."""
    over = W.partitionBy("session_id").orderBy("action_time", tiebreak)
    return actions.select("session_id", "page_id", F.lag("page_id").over(over).alias("before"))


def conversion(actions: DataFrame, flow: list[int], tiebreak: str = "event_id") -> DataFrame:
    """(step, hop, hop_count, rate) for each hop of the flow, in one pass over the actions.

    The first hop is related to the visits of the first page, a further one to the hop before it; a
    rate is null if that count is 0. A flow of fewer than two pages gives no rows.
    """
    pairs = list(zip(flow, flow[1:], strict=False))
    counts = [F.count_if(F.col("page_id") == F.lit(flow[0])).alias("n0") if flow else F.lit(0).alias("n0")]
    counts += [F.count_if((F.col("before") == F.lit(a)) & (F.col("page_id") == F.lit(b))).alias(f"n{k}") for k, (a, b) in enumerate(pairs, 1)]
    row = hops(actions, tiebreak).agg(*counts)
    each = [
        F.struct(F.lit(k).alias("step"), F.lit(f"{a}_{b}").alias("hop"), F.col(f"n{k}").alias("hop_count"), X.ratio(f"n{k}", f"n{k - 1}").alias("rate"))
        for k, (a, b) in enumerate(pairs, 1)
    ]
    made = F.array(*each) if each else F.array().cast("array<struct<step:int,hop:string,hop_count:bigint,rate:double>>")
    return row.select(F.explode(made).alias("x")).select("x.*")


def conversion_text(rates: DataFrame) -> DataFrame:
    """One row with all rates as `1_2=0.5|2_3=0.1`; the flow's few rows are put in order."""
    pair = F.concat("hop", F.lit("="), F.coalesce(F.col("rate").cast("string"), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("step", pair.alias("pair"))))
    return rates.agg(F.array_join(F.transform(ordered, lambda x: x["pair"]), "|").alias("convert_rate"))
