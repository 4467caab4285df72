"""Daily means of an event stream: the batch daily series, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", late: str = "2 days") -> DataFrame:
    """Per day and series: n and mean; works on a stream (state is bounded by the watermark) and on a table."""
    rows = events.withColumn("__t", F.col(ts).cast("timestamp"))
    timed = rows.withWatermark("__t", late) if events.isStreaming else rows
    days = timed.groupBy(F.window("__t", "1 day").alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return days.select(F.to_date("w.start").alias("d"), by, "n", "mean")
