"""Reports on client connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sdk_usage(events: DataFrame, start, end) -> DataFrame:
    """Per SDK: distinct clients and users of connections in [start, end)."""
    seen = events.filter((F.col("connected_at") >= start) & (F.col("connected_at") < end))
    return seen.groupBy("sdk").agg(F.countDistinct("client_id").alias("clients"), F.countDistinct("user_id").alias("users"))


def sdk_report(events: DataFrame, start, end) -> DataFrame:
    """One row: users of the time, and the SDKs' rows as JSON, by name."""
    each = sdk_usage(events, start, end)
    sdks = each.agg(F.to_json(F.sort_array(F.collect_list(F.struct("sdk", "clients", "users")))).alias("sdks"))
    return distinct_users(events, start, end).crossJoin(sdks)


def distinct_users(events: DataFrame, start, end) -> DataFrame:
    seen = events.filter((F.col("connected_at") >= start) & (F.col("connected_at") < end))
    return seen.agg(F.countDistinct("user_id").alias("users"))


def page(events: DataFrame, limit: int, before=None, before_id=None) -> DataFrame:
    """A page of connections, the newest first; ``more`` tells whether another follows."""
    rows = events
    if before is not None:
        rows = rows.filter((F.col("connected_at") < before) | ((F.col("connected_at") == before) & (F.col("id") < before_id)))
    top = rows.orderBy(F.desc("connected_at"), F.desc("id")).limit(limit + 1)
    order = Window.orderBy(F.desc("connected_at"), F.desc("id"))  # over limit + 1 rows at most
    numbered = top.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.filter(F.col("rn") <= limit).withColumn("more", F.col("n") > limit).drop("rn", "n")


def rolling_max(samples: DataFrame, window: str = "30 seconds", slide: str = "5 seconds") -> DataFrame:
    """Largest value per aligned window."""
    w = samples.groupBy(F.window("ts", window, slide)).agg(F.max("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "value")


def storage_sizes(log: DataFrame) -> DataFrame:
    """What a log holds: bytes of data, and ops."""
    return log.agg(F.sum(F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint")).alias("data_bytes"), F.count("*").alias("ops"))
