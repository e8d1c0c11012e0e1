"""Sequences that never end: pauses between events and spans of sound, over Structured Streaming.

Both take a streaming DataFrame with keys and a timestamp, and give each result once, when the watermark shows that nothing earlier can come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound_spans(events: DataFrame, keys: list[str], time: str, mask: Column, gap: str, late: str) -> DataFrame:
    """Spans of events that fulfil mask, none further than gap from the next: keys, start, stop (the last event), length.

    State: one session a key and open span. Events later than late are dropped, and those without a time.
    """
    # Named with the time, the mask stays above the watermark, which all events move; Spark would push a bare mask below it.
    held = events.withWatermark(time, late).where(F.when(F.col(time) > F.lit("0001-01-01").cast("timestamp"), mask))
    span = held.groupBy(*keys, F.session_window(time, gap).alias("_span"))
    return span.agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("length")).drop("_span")


def long_pauses(events: DataFrame, keys: list[str], time: str, least: str, late: str) -> DataFrame:
    """Ends of spans without an event for least: keys, pause_start. One row for each, also for the pause after the last event so far."""
    return sound_spans(events, keys, time, F.col(time).isNotNull(), least, late).select(*keys, F.col("stop").alias("pause_start"))


def window_counts(events: DataFrame, keys: list[str], time: str, width: str, late: str, *aggs: Column) -> DataFrame:
    """Rows and aggs a key and tumbling window: keys, start, stop, rows."""
    at = events.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("_w")).agg(F.count("*").alias("rows"), *aggs)
    return at.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("stop"), *[c for c in at.columns if c not in keys and c != "_w"])
