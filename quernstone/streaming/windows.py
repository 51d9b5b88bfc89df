"""Event-time windows for streams (an extension): the same aggregation works on batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, key, n, total`` of tumbling windows; on a stream, state is dropped behind the watermark."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    out = e.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("decimal(18,4)")), 2).cast("double").alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), key, "n", "total")
