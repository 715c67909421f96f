"""Extension: item support kept up to date while rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_support(events: DataFrame, time_col: str, item_col: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, item, count) of every time window; rows later than ``late`` are left out and closed windows leave the state."""
    timed = events.select(F.col(time_col).cast("timestamp").alias("ts"), F.lower(F.col(item_col)).alias("item")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "item").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "item", "count")


def running_support(baskets: DataFrame) -> DataFrame:
    """(dataset_id, item, count) over all baskets so far (output mode complete or update)."""
    return baskets.groupBy("dataset_id", "item").agg(F.count("*").alias("count"))
