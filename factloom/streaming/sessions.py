"""An addition of this engine: sessions of a stream of events, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, value): the same for a stream and a table.

    A watermark needs timestamps of a zone, so a stream's times without one are taken in the session's zone and given back
    without it; a zone with daylight saving time would fold an hour a year.
    """
    kind = events.schema["ts"].dataType
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "n", "value")
