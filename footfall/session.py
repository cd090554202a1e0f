"""The one session builder of all jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the queries' results rely on; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "footfall", master: str | None = None, hive: bool = False, **settings: str) -> SparkSession:
    """A session; a master only for local runs, a Hive catalog on request."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    if hive:
        builder = builder.enableHiveSupport()
    return builder.getOrCreate()
