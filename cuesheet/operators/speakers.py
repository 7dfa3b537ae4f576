"""Speaker grouping: similarities, clusters, labels by time and by first appearance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of numbers."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, summed by component before the shuffle."""
    parts = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))


def merge_small(df: DataFrame, label: str, vector: str, weight: str, least: float) -> DataFrame:
    """(label, to): labels of less weight than ``least`` go to the nearest large centroid.

    The pairs are labels, not rows: a small label meets each large one once.
    """
    total = df.groupBy(label).agg(F.sum(weight).alias("w"))
    c = centroids(df, label, vector).join(total, label)
    large = c.where(F.col("w") >= least).select(F.col(label).alias("to"), F.col("center").alias("to_center"))
    pairs = c.where(F.col("w") < least).join(large)
    w = Window.partitionBy(label).orderBy(F.desc("sim"), "to")
    near = pairs.withColumn("sim", cosine(F.col("center"), F.col("to_center"))).withColumn("r", F.row_number().over(w)).where("r = 1").select(label, "to")
    return total.select(label).join(near, label, "left").select(label, F.coalesce("to", label).alias("to"))


def upgma(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Average-linkage labels from 0 on cosine distance, cut at ``threshold``."""
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, np.inf)
    size, group = np.ones(n), np.arange(n)
    while n > 1:
        a, b = sorted(divmod(int(dist.argmin()), len(dist)))
        if not dist[a, b] <= threshold:
            break
        joined = (size[a] * dist[a] + size[b] * dist[b]) / (size[a] + size[b])
        dist[a], dist[:, a] = joined, joined
        dist[b], dist[:, b] = np.inf, np.inf
        dist[a, a] = np.inf
        size[a] += size[b]
        group[group == b] = a
    return np.unique(group, return_inverse=True)[1]


def cluster(df: DataFrame, key: str, order: str, vector: str, threshold: float = 0.45) -> DataFrame:
    """cluster of each row within its document."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "cluster": upgma(np.stack(pdf[vector].tolist()).astype(float), threshold)})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, cluster long")


def nearest_in_time(df: DataFrame, keys: list[str], at: str, labelled: Column, value: str) -> DataFrame:
    """Rows without label with the value of the nearest labelled row, earlier on a tie.

    One window forward and one back; no join of rows with rows.
    """
    w = Window.partitionBy(*keys).orderBy(at, value)
    mark = F.when(labelled, F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    before = F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(mark, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = df.withColumn("_before", before).withColumn("_after", after).where(~labelled)
    back = F.col(at) - F.col("_before.t")
    on = F.col("_after.t") - F.col(at)
    take_before = F.col("_before").isNotNull() & (F.col("_after").isNull() | (back <= on))
    return both.withColumn("near", F.when(take_before, F.col("_before.v")).otherwise(F.col("_after.v"))).drop("_before", "_after")


def first_names(df: DataFrame, keys: list[str], label: str, at: str) -> DataFrame:
    """(keys, label, name): S1, S2, ... by first appearance."""
    first = df.groupBy(*keys, label).agg(F.min(at).alias("first"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("first", label))
    return first.select(*keys, label, F.concat(F.lit("S"), n.cast("string")).alias("name"))


def turns(df: DataFrame, keys: list[str], order: str, speaker: str) -> DataFrame:
    """Rows of one speaker in a row: turn_no, n and chars."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(speaker).over(w).eqNullSafe(F.col(speaker)), 0).otherwise(1)
    t = df.withColumn("turn_no", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "turn_no").agg(F.first(speaker).alias(speaker), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
