"""Scores, robust statistics, ranking and pairing."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def robust(df: DataFrame, keys: list[str], col: str, floor: float) -> DataFrame:
    """Median and scale (1.4826 times the median distance from it, ``floor`` at least)."""
    mid = df.groupBy(*keys).agg(F.median(col).alias("mid"))
    away = df.join(mid, keys).groupBy(*keys, "mid").agg(F.median(F.abs(F.col(col) - F.col("mid"))).alias("mad"))
    return away.select(*keys, "mid", F.greatest(F.lit(floor), F.col("mad") * 1.4826).alias("scale"))


def robust_z(df: DataFrame, keys: list[str], col: str, floor: float) -> DataFrame:
    return df.join(robust(df, keys, col, floor), keys).withColumn("z", (F.col(col) - F.col("mid")) / F.col("scale"))


def disagreement(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Median distance of differences from their median; null for under three rows."""
    mid = df.groupBy(*keys).agg(F.median(diff).alias("mid"), F.count(diff).alias("n"))
    away = df.join(mid, keys).groupBy(*keys, "n").agg(F.median(F.abs(F.col(diff) - F.col("mid"))).alias("mad"))
    return away.select(*keys, "n", F.when(F.col("n") >= 3, F.col("mad")).alias("disagreement"))


def take_total(err: Column, voice: Column, spread: Column, length: Column, slot: Column, max_error: float = 0.15, max_stretch: float = 1.15) -> Column:
    """Cost of a take: errors, likeness of voice, performance, fit; null parts count nothing."""
    none = F.lit(0.0)
    fit = F.when((slot > 0) & (length > 0), F.greatest(none, length / slot - max_stretch) * 5.0)
    parts = [err * 4.0 + F.when(err > max_error, 10.0).otherwise(0.0), (1.0 - voice) * 2.0, spread / 6.0, fit]
    return sum((F.coalesce(p, none) for p in parts), none)


def top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def pair_last(a: DataFrame, b: DataFrame, key: str, order: list) -> DataFrame:
    """Every row of ``a`` with the last row of ``b`` of its key."""
    last = b.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")
    return a.join(last, key)


def sign_test_p(a: Column, b: Column) -> Column:
    """Two-sided exact binomial probability of wins a and b at even chances, 4 digits."""

    def p(x, y):
        n, low = int(x + y), int(min(x, y))
        return 1.0 if n == 0 else round(min(1.0, 2 * sum(comb(n, k) for k in range(low + 1)) / 2**n), 4)

    run = F.pandas_udf(lambda x, y: x.combine(y, p).astype(float), T.DoubleType())
    return run(a, b)


def slot(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.08) -> DataFrame:
    """slot: seconds until the next row less ``gap``, 0.2 at least; the last its own and 1."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, end))
    return df.withColumn("slot", F.when(nxt.isNull(), F.col(end) - F.col(start) + 1.0).otherwise(F.greatest(F.lit(0.2), nxt - F.col(start) - gap)))


def fit_factor(length: Column, slot_: Column, natural: Column, most: float = 1.15, least: float = 0.9) -> Column:
    """Tempo factor: faster if a take is longer than its slot, slower if far too short."""
    fast = F.least(F.lit(most), length / slot_)
    slow = F.greatest(F.lit(least), length / natural)
    return F.when((slot_ > 0) & (length > slot_), fast).when((natural > 0) & (length < natural * 0.85), slow).otherwise(1.0)


def budget(syllables: Column, duration: Column, ratio: float, rate: float, voice_rate: float = 1.0, tolerance: float = 0.1) -> Column:
    """struct(target, lo, hi, by): syllables that a translation may have."""
    scaled, cap = syllables * ratio, duration * rate * voice_rate
    by_time = (duration > 0) & (cap < scaled)
    target = F.greatest(F.lit(1), F.bround(F.when(by_time, cap).otherwise(scaled), 0).cast("long"))
    slack = F.greatest(F.lit(1), F.bround(target * tolerance, 0).cast("long"))
    return F.struct(target.alias("target"), F.greatest(F.lit(1), target - slack).alias("lo"), (target + slack).alias("hi"), F.when(by_time, "time").otherwise("ratio").alias("by"))
