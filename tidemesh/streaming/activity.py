"""Activity of entities in time windows, for tables and for streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, entity: str, ts: str, length: str = "1 day", late: str | None = None) -> DataFrame:
    """(entity, start, events): counts in windows of a fixed length; rows later than `late` are left out of a stream.
    Rows without a time belong to no window."""
    rows = events.where(F.col(ts).isNotNull()).select(F.col(entity).alias("entity"), F.col(ts).cast("timestamp").alias("ts"))
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("entity", F.window("ts", length).alias("w")).agg(F.count("*").alias("events")).select("entity", F.col("w.start").alias("start"), "events")
