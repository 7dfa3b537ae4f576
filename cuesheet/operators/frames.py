"""Curves on a frame axis (doc, i, value): runs, peaks, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def active_segments(df: DataFrame, keys: list[str], active: Column, bridge: int, least: int) -> DataFrame:
    """[first, last) runs of active frames; gaps under ``bridge`` joined, short runs dropped."""
    w = Window.partitionBy(*keys).orderBy("i")
    live = df.where(active)
    new = F.when(F.col("i") - F.lag("i").over(w) - 1 < F.greatest(F.lit(1), F.lit(bridge)), 0).otherwise(1)
    runs = live.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*keys, "run").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"))
    return spans.where(F.col("last") - F.col("first") >= least).select(*keys, "first", "last")


def pick_peaks(df: DataFrame, keys: list[str], value: str, near: int, window: int, delta: float) -> DataFrame:
    """Frames that are the highest within ``near`` and ``delta`` over the moving mean.

    Of a plateau only the first frame stays.  ``window`` is odd: the mean is centred.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    high = F.max(value).over(w.rowsBetween(-near, near))
    mean = F.avg(value).over(w.rowsBetween(-(window // 2), window // 2))
    c = df.withColumn("_high", high).withColumn("_mean", mean)
    c = c.where((F.col(value) == F.col("_high")) & (F.col(value) >= F.col("_mean") + delta) & (F.col(value) > 0))
    gap = F.col("i") - F.lag("i").over(w)
    return c.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > near)).drop("_high", "_mean", "_gap")


def normalize(df: DataFrame, keys: list[str], value: str, share: float = 0.97) -> DataFrame:
    """value over the ``share`` percentile of what is above 0, cut at 1.5, over 1.5."""
    p = df.where(F.col(value) > 0).groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("_p"))
    scaled = F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.col(value)) / F.coalesce(F.nullif(F.col("_p"), F.lit(0.0)), F.lit(1.0))) / 1.5
    return df.join(p, keys, "left").withColumn("norm", scaled).drop("_p")
