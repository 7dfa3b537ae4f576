"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Character n-grams of one to three letters are hashed; how many texts hold a bucket is
counted over all texts that may be learned from, summed per task before the shuffle.  A
text's vector is log term frequency times inverse text frequency, scaled to length one.
Weights are learned with follow-the-regularised-leader and elastic-net penalties on a
bounded sample of distinct texts, those whose hash is under a threshold, and the scores
calibrated by one temperature on a part kept from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, crc_mod, table, with_field

SIZES = 3
BITS = 15
#: Bound of the texts that weights are learned from: so many are expected under the hash threshold if no text repeats.
#: The driver holds four bytes for each distinct n-gram of each, 2 ** BITS at most.
MAX_SAMPLE = 6000
#: Steps of the hash threshold.
STEPS = 1 << 40
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
UNKNOWN = "und"

_ODD = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs.

    Letters lower-cased; everything else is one space, as at the text's ends.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep]
    codes = np.concatenate((np.full(1, 32, np.uint32), codes, np.full(1, 32, np.uint32)))
    out, at = np.zeros(1 << BITS, np.int64), np.zeros(len(codes), np.uint32)
    for k in range(SIZES):
        at = at[: len(codes) - k] + codes[k:] * _ODD[k]
        out += np.bincount((at * _ODD[0]) >> np.uint32(32 - BITS), minlength=1 << BITS)
    found = np.flatnonzero(out)
    return found, out[found]


_known = np.zeros(0, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    global _known
    if not len(_known):
        _known = np.array([chr(c).isalpha() for c in range(0x30000)], bool)
    return _known[np.minimum(codes, len(_known) - 1)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _presence(batches):
    held, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            held[counts(text)[0]] += 1
            n += 1
    found = np.flatnonzero(held)
    buckets = np.concatenate((found, [1 << BITS]))
    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.concatenate((held[found], [n])), pa.int64())], ["bucket", "n"])


def _vectors(batches):
    """Buckets and how often each occurs, as 16-bit numbers; more than 65,535 times count as that."""
    kinds = pa.list_(pa.uint16())
    for batch in batches:
        both = [counts(t) for t in batch.column("text").to_pylist()]
        lists = [pa.array([x[k].clip(max=65_535).astype(np.uint16) for x in both], kinds).cast(pa.list_(pa.int16()), safe=False) for k in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), *lists], ["lang", "f", "c"])


def vector(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(times)) * idf[found]
    size = np.sqrt((v * v).sum())
    return v / size if size > 0 else v


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> np.ndarray:
    """Weights (bucket, class) by per-coordinate FTRL-proximal; the last bucket is the bias."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros((size, classes)), np.zeros((size, classes)), np.zeros((size, classes))
    order = np.random.RandomState(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            f, v = np.append(f, size - 1), np.append(v, 0.2)[:, None]
            now = w[f]
            logits = (now * v).sum(axis=0)
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v * p
            old = n[f]
            new = old + g * g
            n[f] = new
            at = z[f] + g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * now
            z[f] = at
            w[f] = np.where(np.abs(at) > L1, -(at - np.sign(at) * L1) / ((BETA + np.sqrt(new)) / ALPHA + L2), 0.0)
    return w


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with least log loss."""
    if not len(y):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(5), 60)):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def train(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> dict:
    """Model from ``docs`` (text, lang): document frequencies over all, weights of a sample.

    Rows without language, text or letter teach nothing.
    """
    bound_batches(docs.sparkSession)
    known = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    held = known.select("text").mapInArrow(_presence, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << BITS) + 1)
    df[held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    total = df[-1]
    idf = np.log((1 + total) / (1 + df[:-1])) + 1
    # A third of all rows may hold one text: a text counts once, and the partial step drops its copies before the shuffle.
    place = F.pmod(F.xxhash64("text"), F.lit(STEPS))
    sample = known.withColumn("place", place).where(F.col("place") < F.lit(int(STEPS * min(1.0, max_sample / max(1.0, total))))).dropDuplicates(["place", "lang"])
    got = sample.repartition(24, "place").select("text", "lang").mapInArrow(_vectors, "lang string, f array<short>, c array<short>").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return {"langs": [], "idf": idf, "w": np.zeros(((1 << BITS) + 1, 0)), "t": 1.0}
    f, c = got.column("f").combine_chunks(), got.column("c").combine_chunks()
    ends = list(zip(f.offsets.to_numpy(), f.offsets.to_numpy()[1:]))
    fv, cv = f.values.to_numpy().view(np.uint16), c.values.to_numpy().view(np.uint16)
    rows = [(fv[a:b].astype(np.int64), vector(fv[a:b], cv[a:b], idf)) for a, b in ends]
    said = [langs.index(x) for x in got.column("lang").to_pylist()]
    # The order in which rows came is left to chance: their own is by what they hold.
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i][0]), int(rows[i][0].sum()), float(rows[i][1].sum()), said[i]))
    rows, y = [rows[i] for i in order], np.array([said[i] for i in order])
    fit = np.array([int(r[0].sum()) % 5 != 0 for r in rows])
    w = ftrl([r for r, k in zip(rows, fit) if k], y[fit], len(langs))
    kept = [(w[r[0]] * r[1][:, None]).sum(axis=0) + 0.2 * w[-1] for r, k in zip(rows, fit) if not k]
    t = temperature(np.array(kept).reshape(-1, len(langs)), y[~fit])
    return {"langs": langs, "idf": idf, "w": w, "t": t}


def predict_text(text: str | None, model: dict) -> tuple[str, float]:
    """Language and score; ``und`` and 0 where nothing can be told."""
    if not has_letter(text) or not model["langs"]:
        return UNKNOWN, 0.0
    found, times = counts(text)
    v = vector(found, times, model["idf"])
    s = (v @ model["w"][found] + 0.2 * model["w"][-1]) / model["t"]
    p = np.exp(s - s.max())
    k = int(p.argmax())
    return model["langs"][k], float(p[k] / p.sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score.

    Null texts and texts without letter are ``und`` with score 0; a very long text is read
    whole by one worker; repeated rows are judged alike; own columns of these names are
    replaced; an empty table is fine.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches):
        model = shared.value
        for batch in batches:
            out = [predict_text(t, model) for t in batch.column("text").to_pylist()]
            yield batch.append_column("lang_pred", pa.array([o[0] for o in out], pa.string())).append_column("score", pa.array([o[1] for o in out], pa.float64()))

    kept = docs.drop("lang_pred", "score")
    return kept.mapInArrow(run, with_field(with_field(kept.schema, "lang_pred", T.StringType()), "score", T.DoubleType()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned outside the held-out part."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
