"""An extension: the hopping windows over a stream of events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping(events: DataFrame, length: str = "10 minutes", hop: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per user and window: n, mean and peak-to-peak of value. ts may be TIMESTAMP_NTZ; batch input works too."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = timed.groupBy(F.window("ts", length, hop), "user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("ptp"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_id", "n", "mean", "ptp")
