"""Streaming forms of pause segmentation, density and duplicate screening.

The batch operators have no notion of late data; these are extensions for live feeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pause_sessions(events: DataFrame, key: str, at: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of events without a pause of ``gap``: closed once the watermark passes them."""
    s = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(s.alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def window_counts(events: DataFrame, key: str, at: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Events in sliding windows, for density limits."""
    w = F.window(at, width, slide)
    return events.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def without_repeats(lines: DataFrame, at: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Lines whose keys weren't seen within the watermark."""
    return lines.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
