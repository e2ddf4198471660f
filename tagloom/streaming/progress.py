"""Roll-ups of progress events ``(ts, job, current, total, status)``, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_progress(events: DataFrame) -> DataFrame:
    """Per job the latest position and counts by status."""
    latest = F.max_by(F.struct("current", "total"), F.struct("ts", "current"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "error", "processing")]
    return events.groupBy("job").agg(latest.alias("at"), *counts).select(
        "job", "at.current", "at.total", "success", "error", "processing"
    )


def throughput(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per status and tumbling window; late ones are dropped in a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    rows = timed.groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "status", "n")
