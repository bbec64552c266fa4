"""An extension: the monthly usage rollup kept up to date from a stream. The batch rollup is orrery.operators.usage.monthly_rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def daily_views(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Views and distinct users (approximate) of a stream of events (ts, report_name, user_email) by day; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "report_name").agg(F.count(F.lit(1)).alias("views"), F.approx_count_distinct("user_email").alias("users")).select(F.col("window.start").cast("date").alias("day"), "report_name", "views", "users")


def keep(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished days to a table partitioned by day; what is written twice after a failure is written once."""
    return rollup.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
