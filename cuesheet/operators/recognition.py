"""Results of speech recognition as timed tokens and documents.

A transcript is a table of words (key, seg_no, word_no, text, start, end, prob), or of
segments (key, seg_no, text, start, end) where a recogniser gives no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import CJK, tokenize, weight

#: Trust in a token whose time is a share of a recognised word's; in one of a stamp list that doesn't fit.
SHARED, UNSURE = 0.8, 0.5
CJK_CHAR = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK) + "]"

WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
VERBOSE = T.StructType([T.StructField("language", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(WORD)), T.StructField("segments", T.ArrayType(SEGMENT))])


def is_cjk_start(text: Column) -> Column:
    return F.trim(text).rlike("^" + CJK_CHAR)


def word_tokens(words: DataFrame, keys: list[str]) -> DataFrame:
    """Token rows (keys, word_no, i, text, start, end, confidence, space_after) of words (text, start, end, prob).

    A word of several units shares its time out by their weights, and is trusted less.
    Words without a unit give nothing; keys and word_no tell words apart.
    """
    t = words.select(*keys, "word_no", "start", "end", "prob", F.posexplode(tokenize("text")).alias("i", "u")).withColumn("w", weight(F.col("u.text")))
    word = Window.partitionBy(*keys, "word_no")
    upto, total, n = F.sum("w").over(word.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.sum("w").over(word), F.count(F.lit(1)).over(word)
    length = F.col("end") - F.col("start")
    t = t.withColumns({"_upto": upto, "_all": total, "_n": n})
    share = lambda x: F.col("start") + length * x / F.col("_all")
    out = t.withColumns({"_a": F.when(F.col("_n") == 1, F.col("start")).otherwise(share(F.col("_upto") - F.col("w"))), "_b": F.when(F.col("_n") == 1, F.col("end")).otherwise(share(F.col("_upto")))})
    trust = F.col("prob") * F.when(F.col("_n") == 1, 1.0).otherwise(SHARED)
    return out.select(*keys, "word_no", "i", F.col("u.text").alias("text"), F.col("_a").alias("start"), F.col("_b").alias("end"), trust.alias("confidence"), F.col("u.space_after").alias("space_after"))


def segment_tokens(words: DataFrame, keys: list[str]) -> DataFrame:
    """``word_tokens`` in one order by ``keys``: a word that comes with its leading space gives it to the token before."""
    spaced = words.select(*keys, "word_no", F.col("text").rlike(r"^\s").alias("_spaced"))
    t = word_tokens(words, keys).join(spaced, [*keys, "word_no"])
    w = Window.partitionBy(*keys).orderBy("word_no", "i")
    opens = (F.lead("i").over(w) == 0) & F.lead("_spaced").over(w)
    return t.withColumn("space_after", F.col("space_after") | F.coalesce(opens, F.lit(False))).withColumn("tok_no", F.row_number().over(w) - 1).drop("_spaced", "i", "word_no")


def spread_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Token rows of segments (text, start, end) without words: their time shared out by weight."""
    t = segments.select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b"), F.posexplode(tokenize("text")).alias("tok_no", "u")).withColumn("w", weight(F.col("u.text")))
    seg = Window.partitionBy(*keys)
    t = t.withColumns({"_upto": F.sum("w").over(seg.orderBy("tok_no").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("w").over(seg), "_len": F.greatest(F.col("_a"), F.col("_b")) - F.col("_a")})
    at = lambda x: F.col("_a") + F.col("_len") * x / F.col("_all")
    return t.select(*keys, "tok_no", F.col("u.text").alias("text"), at(F.col("_upto") - F.col("w")).alias("start"), at(F.col("_upto")).alias("end"), F.lit(1.0).alias("confidence"), F.col("u.space_after").alias("space_after"))


def transcript_tokens(tokens: DataFrame, key: str, seg: str = "seg_no") -> DataFrame:
    """All tokens of a transcript in one stream: a space between segments unless CJK meets CJK."""
    w = Window.partitionBy(key).orderBy(seg, "tok_no")
    border = F.lead(seg).over(w) != F.col(seg)
    wide = F.substring("text", -1, 1).rlike(CJK_CHAR) & F.substring(F.lead("text").over(w), 1, 1).rlike(CJK_CHAR)
    return tokens.withColumn("space_after", F.when(border, ~wide | F.col("space_after")).otherwise(F.col("space_after"))).withColumn("g_no", F.row_number().over(w) - 1)


def to_lines(tokens: DataFrame, key: str, seg: str = "seg_no") -> DataFrame:
    """Lines (key, line_no, start, end, tokens) of a transcript: each segment with tokens one, bounds from them."""
    token = F.struct("tok_no", "text", "start", "end", "confidence", "space_after")
    t = tokens.groupBy(key, seg).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(token)).alias("t"))
    n = F.size("t")
    bare = F.transform("t", lambda x, i: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["confidence"].alias("confidence"), (x["space_after"] & (i < n - 1)).alias("space_after")))
    w = Window.partitionBy(key).orderBy(seg)
    return t.select(key, (F.row_number().over(w) - 1).alias("line_no"), "start", "end", bare.alias("tokens"))


def verbose_words(df: DataFrame, key: str, col: str = "json") -> DataFrame:
    """Words (key, language, seg_no, word_no, text, start, end, prob) of a recogniser's verbose JSON.

    A word belongs to the first segment that ends after it starts; words after the last
    segment's end go to the last one.  Within a segment a word gets its leading space
    unless it has one or is CJK.  Texts that are no JSON, or hold no words, give nothing.
    """
    d = df.select(key, F.from_json(col, VERBOSE).alias("d"))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.coalesce("d.duration", F.lit(0.0)).alias("end"), F.coalesce("d.text", F.lit("")).alias("text")))
    segs = F.when(F.size("d.segments") > 0, F.col("d.segments")).otherwise(whole.cast(T.ArrayType(SEGMENT)))
    w = d.select(key, "d.language", segs.alias("segs"), F.posexplode("d.words").alias("word_no", "w"))
    # The reader never goes back, so the segment is at least that of the words before.
    fits = F.array_position(F.transform("segs", lambda s: F.col("w.start") < s["end"] - 1e-3), True)
    own = F.when(fits > 0, fits - 1).otherwise(F.size("segs") - 1).cast("int")
    upto = Window.partitionBy(key).orderBy("word_no").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("seg_no", F.max(own).over(upto))
    order = Window.partitionBy(key, "seg_no").orderBy("word_no")
    bare = ~F.col("w.word").startswith(" ") & (F.row_number().over(order) > 1) & ~is_cjk_start(F.col("w.word"))
    return w.select(key, "language", "seg_no", "word_no", F.when(bare, F.concat(F.lit(" "), F.col("w.word"))).otherwise(F.col("w.word")).alias("text"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.lit(1.0).alias("prob"))


def stamped_words(df: DataFrame, keys: list[str], text: str = "text", stamps: str = "stamps") -> DataFrame:
    """Words (keys, word_no, text, start, end, prob) of a text with a list of (from, to) in milliseconds.

    As many stamps as units: one each; else the whole span in even steps, trusted less;
    no stamps: nothing.  Units without a letter or digit don't count.
    """
    units = F.filter(tokenize(F.col(text)), lambda u: u["text"].rlike(r"[\p{L}\p{N}]"))
    t = df.select(*keys, F.col(stamps).alias("_s"), units.alias("_u")).where(F.size("_s") > 0)
    t = t.select(*keys, "_s", F.size("_u").alias("_n"), F.posexplode("_u").alias("word_no", "u"))
    each = F.size("_s") == F.col("_n")
    first, last = F.get("_s", F.lit(0))["from"] / 1000.0, F.element_at("_s", -1)["to"] / 1000.0
    step = (last - first) / F.col("_n")
    own = F.get("_s", F.col("word_no"))
    start = F.when(each, own["from"] / 1000.0).otherwise(first + F.col("word_no") * step)
    end = F.when(each, own["to"] / 1000.0).otherwise(first + (F.col("word_no") + 1) * step)
    said = F.when(each & F.col("u.space_after"), F.concat(F.col("u.text"), F.lit(" "))).otherwise(F.col("u.text"))
    return t.select(*keys, "word_no", said.alias("text"), start.alias("start"), end.alias("end"), F.when(each, 1.0).otherwise(UNSURE).alias("prob"))
