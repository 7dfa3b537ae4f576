"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log ratios.

Whether a text holds an n-gram is a feature, scaled by the log ratio of the n-gram's
smoothed rates among toxic and other texts; a logistic regression on these learns
weights, bias and thereby calibrated scores.  N-grams are hashed.  The classifier is
fitted on at most ``MAX_LABELLED`` labelled rows, picked by a hash of the id, so its cost
is fixed; every text is scored whole and in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, crc_mod, table, with_field

SIZES = (5, 8)
BITS = 20
#: Bound of the labelled rows that the classifier is fitted on.
MAX_LABELLED = 12_000
#: Tasks that turn the sample into n-grams.
PARTS = 8
SMOOTH = 1.0
#: N-grams in fewer texts of the sample say nothing reliable.
MIN_TEXTS = 8
MIN_RATIO = 1.0
PENALTY = 1e-3
STEPS = 400
THRESHOLD = 0.3

_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xC2B2AE3D27D4EB4F >> k) & (2**64 - 1) | 1) for k in range(16)]


def features(text: str, sizes: tuple = SIZES, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams of a text with repeats, lower case, white space as one space."""
    text = f" {' '.join(text.lower().split())} "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, at, done = [], np.zeros(len(codes), np.uint64), 0
    for n in sorted(sizes):
        for k in range(done, n):
            if len(codes) <= k:
                break
            at = at[: len(codes) - k] + codes[k:] * _ODD[k]
        if len(codes) >= n:
            done = n
            out.append(((at * _ODD[n - 1]) >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def distinct(f: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The distinct buckets of ``f``, by marking each bucket's last occurrence in ``place``."""
    at = np.arange(len(f), dtype=np.int32)
    place[f] = at
    return f[place[f] == at]


def log_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Naive Bayes log ratio of smoothed rates among toxic and other texts."""
    return np.log((pos + SMOOTH) / (n_pos + 2 * SMOOTH)) - np.log((neg + SMOOTH) / (n_neg + 2 * SMOOTH))


def fit(samples: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each feature and bias: logistic regression on the ratios of what a text has."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        return np.zeros(len(ratio)), float(np.log(rate / (1 - rate)))
    rows = np.repeat(np.arange(len(samples), dtype=np.int32), [len(f) for f in samples])
    cols = np.concatenate(samples)
    w, b = np.zeros(len(ratio)), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    value = ratio[cols]
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[cols] * value, len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(cols, err[rows] * value, len(w)) + PENALTY * w
        gb = err.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.02 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-9)
        b -= 0.02 * (mb1 / fix1) / (np.sqrt(mb2 / fix2) + 1e-9)
    return w * ratio, float(b)


def _count(batches):
    """Of each bucket, how many toxic and other texts of a task hold it."""
    held, place = np.zeros((2, 1 << BITS), np.int32), np.zeros(1 << BITS, np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            held[int(toxic > 0), distinct(features(text or ""), place)] += 1
    found = np.flatnonzero(held.any(axis=0))
    for k in range(0, len(found), 100_000):
        part = found[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(held[1, part], pa.int32()), pa.array(held[0, part], pa.int32())], ["bucket", "pos", "neg"])


def _chosen_features(place_of: np.ndarray):
    def run(batches):
        place = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                f = place_of[distinct(features(t or ""), place)]
                out.append(f[f >= 0])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.list_(pa.int32()))], ["toxic", "f"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_labelled`` rows of ``labels`` (doc_id, toxic), by hash of the id.

    Labels of one id that differ count as toxic; null ids and labels are not used.
    Returns the weight of each bucket and the bias.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "toxic")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most max_labelled rows of twelve bytes: safe to broadcast at any input size.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text")).limit(max_labelled)
    sample = scratch.keep(sample.select("toxic", "text").repartition(PARTS))
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(True, 0), n.get(False, 0)
    sums = sample.mapInArrow(_count, "bucket int, pos int, neg int").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.log((F.col("pos") + SMOOTH) / (n_pos + 2 * SMOOTH)) - F.log((F.col("neg") + SMOOTH) / (n_neg + 2 * SMOOTH))
    # One row for a bucket at most, and few of them tell.
    telling = sums.where((F.col("pos") + F.col("neg") >= MIN_TEXTS) & (F.abs(ratio) >= MIN_RATIO)).orderBy("bucket").toArrow()
    bucket = telling.column("bucket").to_numpy()
    scale = log_ratio(telling.column("pos").to_numpy(), telling.column("neg").to_numpy(), n_pos, n_neg)
    place_of = np.full(1 << BITS, -1, np.int32)
    place_of[bucket] = np.arange(len(bucket), dtype=np.int32)
    got = sample.mapInArrow(_chosen_features(place_of), "toxic int, f array<int>").toArrow()
    scratch.drop()
    f = got.column("f").combine_chunks()
    offsets, values = f.offsets.to_numpy(), f.values.to_numpy()
    w, bias = fit([values[a:b] for a, b in zip(offsets, offsets[1:])], got.column("toxic").to_numpy() > 0, scale)
    weights = np.zeros(1 << BITS, np.float32)
    weights[bucket] = w
    return weights, bias


def score_text(text: str, weights: np.ndarray, bias: float) -> float:
    f = features(text)
    w = weights[f]
    hit = w != 0
    if hit.any():
        f, first = np.unique(f[hit], return_index=True)
        bias = bias + float(w[hit][first].sum(dtype=np.float64))
    return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, bias)))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """``docs`` with ``name``, 0 to 1; null and empty texts get the score of no n-gram.

    Repeated rows get equal scores; an own column of that name is replaced; a very long
    text is read whole by one worker; an empty table is fine.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 MB, whatever the input

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            out = [score_text(t or "", weights, bias) for t in batch.column("text").to_pylist()]
            yield batch.append_column(name, pa.array(out, pa.float64()))

    kept = docs.drop(name)
    return kept.mapInArrow(run, with_field(kept.schema, name, T.DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, name: str = "score") -> DataFrame:
    """Train on ``labels`` of ``docs`` and score every row of ``docs`` in the column ``name``."""
    return score(docs, train(docs, labels, max_labelled), name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    out = toxicity(docs, labels)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
