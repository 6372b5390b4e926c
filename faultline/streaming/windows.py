"""An extension: tumbling statistics of a metric stream, with late rows up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_windows(long: DataFrame, width: str = "1 minute", late: str = "5 minutes", time: str = "time") -> DataFrame:
    """long: a stream or table (time, object_id, metric, value)."""
    source = long.withWatermark(time, late) if long.isStreaming else long
    out = source.groupBy(F.window(time, width), "object_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "object_id", "metric", "n", "mean", "top")
